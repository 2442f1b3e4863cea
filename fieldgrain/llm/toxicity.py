"""Toxicity by non-negative positive-unlabelled learning (operator 8).

Confirmed toxic documents and unlabelled ones (documents of the whole corpus, toxic ones among them) are enough to learn
from: the risk of calling a document clean is estimated from the unlabelled ones and corrected for the share of toxic
ones among them, and held at zero from below so that the classifier can't gain by it:
    prior * E+[loss(x, 1)] + max(0, E_u[loss(x, 0)] - prior * E+[loss(x, 0)]).
The prior is the share of toxic documents among the labels of the training folds, however many documents these cover.
Features are words and word beginnings, by how many distinct words of the text show them, up to MOST; those that tell
most are chosen by counts over the bounded sample, on the executors, and weights are fitted in numpy. Only the text is an
input of a score, and the whole of it.

null text: as the empty text, whose score is that of no feature. Without confirmed documents every score is 0. An id that
any row confirms is confirmed. Exact copies are learnt from once; of rows that repeat an id one is, the same each time.
Repeated rows are scored each. Ties of features: the smaller hash. Columns named score or predicted are replaced by
rate(), further ones stay. Empty table: no rows. A null doc_id is in no fold: scored, not held out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, drop, fold, some_ids, table

MOST = 5
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features_of_word(raw: str, starts: tuple[int, ...] = (4, 5, 7)) -> tuple[int, ...]:
    """Hashed whole word and, of longer ones, its beginnings."""
    w = EDGE.sub("", raw)
    if not w:
        return ()
    whole = zlib.crc32(b"w" + w.encode())
    return (whole, *(zlib.crc32(b"b" + w[:n].encode()) for n in starts if len(w) > n))


class Chosen(dict):
    """raw word -> places of its chosen features."""

    def __init__(self, places: dict[int, int], most: int = 300_000):
        super().__init__()
        self.places, self.most = places, most

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = self[raw] = tuple(self.places[f] for f in features_of_word(raw) if f in self.places)
        return found

    def of(self, text: str | None) -> list[int]:
        return [i for found in map(self.__getitem__, set(text.lower().split())) if found for i in found] if text else []


class NonNegativePU:
    """Logistic model on chosen features; rows are lists of places, one for each word that shows the feature."""

    def __init__(self, rows: list[list[int]], confirmed: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.03, l2: float = 1e-4):
        x = np.zeros((len(rows), size), np.float32)
        for i, r in enumerate(rows):
            x[i] = np.minimum(np.bincount(np.array(r, int), minlength=size), MOST) if r else 0
        pos, free = x[confirmed], x[~confirmed]
        w, b = np.zeros(size, np.float32), np.float32(np.log(prior / (1 - prior)))
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        for t in range(1, steps + 1):
            p, u = 1 / (1 + np.exp(-(pos @ w + b))), 1 / (1 + np.exp(-(free @ w + b)))
            clean_risk = -np.log1p(-np.minimum(u, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-7)).mean()
            # d loss(x, 1) = p - 1, d loss(x, 0) = p
            g_pos, g_free = prior * (p - 1) / len(p), u / max(1, len(u))
            g_back = -prior * p / len(p)
            if clean_risk >= 0:
                gp, gu = g_pos + g_back, g_free
            else:  # the clean risk has overfitted: go back on it alone
                gp, gu = -g_back, -g_free
            g = np.concatenate([pos.T @ gp + free.T @ gu + l2 * w, [gp.sum() + gu.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(0, w - step[:-1].astype(np.float32)), np.float32(b - step[-1])  # a chosen feature never speaks for a text
        self.w, self.b = w.astype(float), float(b)

    def score(self, places: list[int]) -> float:
        at, n = np.unique(np.array(places, int), return_counts=True) if places else ([], 0)
        return float(1 / (1 + np.exp(-np.clip((self.w[at] * np.minimum(n, MOST)).sum() + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000, chosen: int = 256, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, least_documents: int = 5, least_share: float = 0.005, least_score: float = 6.0, most_lift: float = 30.0) -> tuple[dict[int, int], NonNegativePU] | None:
    """Learns from at most `most` confirmed and `most` unlabelled documents outside the held-out fold, on at most `chosen` features.

    A feature must occur in least_documents and least_share of the confirmed documents, stand out by least_score standard
    deviations from chance, and be more frequent in confirmed documents than in others by a third of what is possible: an
    unlabelled sample holds toxic documents too, so it is 1 / prior at most (most_lift where that is more).
    """
    train = (fold("id", folds) != held) & F.col("id").isNotNull()
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(train & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    toxic, all_known = known.agg(F.sum("y"), F.count("*")).first()
    if not toxic:
        return None
    prior = min(0.5, max(1e-3, toxic / all_known))
    confirmed = some_ids(known.where("y = 1").select("id"), most, "id").withColumn("confirmed", F.lit(True))
    others = some_ids(docs.select(F.col(key).alias("id")).where(train), most, "id").distinct().withColumn("confirmed", F.lit(False))
    sample = cut(confirmed.union(others), "sample")
    wanted = F.broadcast(sample)  # at most 2 x most ids

    def featurize(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "confirmed": b["confirmed"], "found": [[f for w in set((t or "").lower().split()) for f in features_of_word(w)] for t in b["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    joined = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id")
    one = joined.groupBy("id", "confirmed").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    distinct = one.groupBy("text", "confirmed").agg(F.min("id").alias("id"))  # exact copies count once
    rows = cut(distinct.mapInPandas(featurize, f"id {kind}, confirmed boolean, found array<long>"), "features")
    drop(sample)
    n_pos, n_all = rows.agg(F.count_if("confirmed"), F.count("*")).first()
    counts = rows.select("confirmed", F.explode(F.array_distinct("found")).alias("f")).groupBy("f").agg(F.count_if("confirmed").alias("pos"), F.count("*").alias("all"))
    # How much more often in confirmed documents than in others, for features that are not chance finds.
    others_share = (F.col("all") - F.col("pos") + 1) / F.lit(n_all - n_pos + 2)
    expected = others_share * n_pos
    score, lift = (F.col("pos") - expected) / F.sqrt(expected), F.col("pos") / expected
    telling = (F.col("pos") >= max(least_documents, int(n_pos * least_share))) & (lift >= 1 + (min(1 / prior, most_lift) - 1) / 3) & (score >= least_score)
    places = {r.f: i for i, r in enumerate(counts.where(telling).orderBy(score.desc(), "f").limit(chosen).collect())}

    def reduced(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "confirmed": b["confirmed"], "found": [[places[f] for f in r if f in places] for r in b["found"]]})

    sample = rows.mapInPandas(reduced, f"id {kind}, confirmed boolean, found array<int>").toPandas().sort_values(["confirmed", "id"], kind="stable")
    drop(rows)
    if not n_pos:
        return None
    return places, NonNegativePU([list(r) for r in sample["found"]], sample["confirmed"].to_numpy().astype(bool), len(places), prior)


def score(text: Column, model) -> Column:
    @pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        chosen = Chosen(model[0])
        return pd.Series([model[1].score(chosen.of(t)) for t in texts], dtype="float64")

    return scores(text)


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with score and predicted (1: toxic)."""
    return docs.withColumn("score", score(F.col(text), fit(docs, labels, key=key, text=text, **how))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return rate(docs, labels).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
