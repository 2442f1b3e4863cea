"""Token counts by a whole-token shortcut (operator 10).

A sentencepiece BPE model with the identity normalizer puts U+2581 for each space and one in front. No piece of the
vocabulary has U+2581 after another character (checked when the model is loaded), so no merge crosses the start of a
run of U+2581 and a text's count is the sum over its pre-tokens. Offline, once per worker, we encode every vocabulary
string alone and keep those that come out as one token: these are counted by lookup, all others are merged by the
library and remembered in a table of bounded size.

null text: as the empty text, 0 tokens. Empty text: 0. Runs of spaces, leading and trailing spaces and literal U+2581
take the segment path; the result is the library's in all cases. Repeated rows are counted each. Texts of any length are
counted whole. Columns named n_bytes, n_tokens or over_limit are replaced, further ones stay. Empty table: no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import locate, table

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PretokenCounts(dict):
    """pre-token without its leading U+2581 -> number of tokens."""

    def __init__(self, path: str, most: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        odd = [p for p in pieces if SPACE in p.lstrip(SPACE)]
        if odd:
            raise ValueError(f"pieces with an inner space: {odd[:3]}; pre-tokens can't be counted apart")
        bodies = [p[1:] for p in pieces if p[:1] == SPACE and len(p) > 1 and p[1] != SPACE and not self.model.is_control(self.model.piece_to_id(p))]
        #: Proven: alone, each of these is one token.
        self.whole = {b: 1 for b, ids in zip(bodies, self.model.encode(bodies, num_threads=1), strict=True) if len(ids) == 1}
        self.most = most
        self.update(self.whole)

    def __missing__(self, part: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.whole)
        n = len(self.model.encode(part))
        if len(part) < 64:
            self[part] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        n = 0
        for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE)):
            n += 1 if s == SPACE else self[s[1:].replace(SPACE, " ")]
        return n


@lru_cache(maxsize=2)
def _counts(path: str, most: int) -> PretokenCounts:
    return PretokenCounts(path, most)


def count_tokens(df: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096, remembered: int = 400_000) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (columns of these names are replaced). remembered: entries a worker keeps."""

    @pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = _counts(locate(model), remembered).of
        return pd.Series([count(t) for t in texts], dtype="int64")

    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
