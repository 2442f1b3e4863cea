"""Best-fit packing by repeated length patterns (operator 4).

The corpus meets the driver only as a histogram over at most `capacity` lengths. Patterns of one to three lengths that
fill a sequence are enumerated from the lengths that occur, their repeat counts are fitted to the histogram by
non-negative least squares, rounded down, and trimmed to what is there; the residual histogram is packed best-fit
decreasing, run by run. The plan is a list of (pattern, repeats) whose size depends on the capacity and not on the
corpus. Each piece finds its place from its rank among the pieces of its length: a partition's pieces are numbered
where they are made, and a prefix sum over (partition, length) counts makes the numbers global, so that no length, how
frequent ever, is gathered in one task.

null text: as the empty text, one token (the end id). A document of more than `capacity` tokens is cut, the first piece
takes the remainder. Repeated rows are packed each. An empty table gives no rows. Ties: pieces of one length are
interchangeable and placed by their number. Texts of any length are read whole, one at a time. Columns beside the key and
the text are not read, whatever their names. Triples beyond `most_triples` (those of the rarest lengths) are not tried as
patterns; their lengths are packed with the residuals.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, locate, table, thrifty

MARKS, LATIN_END = tuple(".,;:!?)]}\"|#$%&*"), "\u0250"
PACK = {n: struct.Struct(f"<{n}I").pack for n in range(1, 9)}


class ByteBpe(dict):
    """word -> the ids of a space and the word, as little-endian 32-bit numbers; those of a `tokenizers` byte-level BPE file.

    A pre-token begins at every space but inside a run of white space that goes on with another space, so a text without
    two spaces in a row can be encoded word by word, and words be remembered.
    """

    def __init__(self, path: str, most: int):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"].get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merge, self.merge_piece = coder.encode_ordinary, coder._core_bpe.encode_single_piece
        probe = "It's 1,024 tokens\n\nof  náive\ttext…"
        if self.merge(probe) != Tokenizer.from_file(path).encode(probe, add_special_tokens=False).ids:
            raise ValueError("merge order and ranks differ in this file")
        self.most, self.older = most, {}

    def __missing__(self, word: str) -> bytes:
        raw = self.older.get(word) or self._merged(word)
        if len(word) < 48:
            if len(self) >= self.most // 2:  # what was met since the last time is kept for as long again
                self.older = dict(self)
                self.clear()
            self[word] = raw
        return raw

    def _merged(self, word: str) -> bytes:
        if word.isalpha() and max(word) < LATIN_END:  # a space and letters are one pre-token
            ids = self.merge_piece(b" " + word.encode())
        elif word[-1:] in MARKS and word[:-1].isalpha() and max(word) < LATIN_END:  # and a mark that ends them is another
            ids = self.merge_piece(b" " + word[:-1].encode()) + self.merge_piece(word[-1:].encode())
        else:
            ids = self.merge(" " + word)
        return make(*ids) if (make := PACK.get(len(ids))) else np.array(ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        if "  " in text:
            return np.array(self.merge(text), "<u4").tobytes()
        words = text.split(" ")
        words[0] = np.array(self.merge(words[0]), "<u4").tobytes()
        words[1:] = map(self.__getitem__, words[1:])
        return b"".join(words)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut or not self.cut.search(text):
            return self.plain(text)
        return b"".join(self.special[part] if part in self.special else self.plain(part) for part in self.cut.split(text) if part)


@lru_cache(maxsize=2)
def _encoder(path: str, most: int) -> ByteBpe:
    return ByteBpe(path, most)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, model: str = "byte_bpe_50k.json", end: int = 2, remembered: int = 240_000) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and (part, nth): its number among the partition's pieces of that length."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, key_type = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names, mark = ["key", "piece", "start", "length", "ids_crc32", "part", "nth"], end.to_bytes(4, "little")

    def cut_up(batches):
        encode, seen = _encoder(locate(model), remembered).encode, [0] * (capacity + 1)
        for batch in batches:
            row, columns = [], tuple([] for _ in types)
            piece, start, length, crc, parts, nth = columns
            for i, part in enumerate(batch.column(2).to_pylist()):
                raw = memoryview(encode(batch.column(1)[i].as_py()) + mark)  # one text at a time is held as a string
                total, at, n = len(raw) // 4, 0, 0
                to = (total - 1) % capacity + 1
                while at < total:
                    size = to - at
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
                    parts.append(part)
                    nth.append(seen[size])
                    seen[size] += 1
                    at, to, n = to, to + capacity, n + 1
            if row:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)).cast(key_type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("part")).mapInArrow(thrifty(cut_up), f"key {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def enumerate_patterns(hist: np.ndarray, capacity: int, most_triples: int = 6000) -> list[tuple[int, ...]]:
    """Lengths, longest first, that fill a sequence exactly: alone, in pairs, and in the triples most of whose parts are frequent."""
    there = np.flatnonzero(hist)
    found: list[tuple[int, ...]] = [(capacity,)] if hist[capacity] else []
    found += [(capacity - a, a) for a in map(int, there) if a * 2 <= capacity and hist[capacity - a]]
    a, b = np.meshgrid(there, there, indexing="ij")
    keep = (a >= b) & (a + b < capacity)
    a, b = a[keep], b[keep]
    c = capacity - a - b
    keep = (c >= 1) & (b >= c)
    a, b, c = a[keep], b[keep], c[keep]
    keep = hist[c] > 0
    a, b, c = a[keep], b[keep], c[keep]
    weight = np.minimum(np.minimum(hist[a], hist[b]), hist[c])
    best = np.lexsort((c, b, a, -weight))[:most_triples]
    return found + [tuple(map(int, t)) for t in zip(a[best], b[best], c[best], strict=True)]


def nnls(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |Ax - hist|^2, A's columns being the patterns: accelerated projected gradient."""
    n = len(patterns)
    rows = np.array([v for p in patterns for v in p])
    cols = np.repeat(np.arange(n), [len(p) for p in patterns])
    a_x = lambda x: np.bincount(rows, x[cols], minlength=len(hist))
    at_r = lambda r: np.bincount(cols, r[rows], minlength=n)
    v = np.ones(n)
    for _ in range(30):
        v = at_r(a_x(v))
        size = np.linalg.norm(v)
        v /= size
    step, x, y, t = 1 / (1.05 * size), np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * at_r(a_x(y) - hist))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan_sequences(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up hist, an array of counts by length."""
    left, plan = hist.astype(np.int64).copy(), []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need = np.bincount(pattern, minlength=len(left))
        used = np.flatnonzero(need)
        times = int(min(times, (left[used] // need[used]).min()))
        if times > 0:
            left[used] -= need[used] * times
            plan.append((pattern, times))

    if patterns := enumerate_patterns(left, capacity):
        x = nnls(patterns, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            take(patterns[i], int(x[i]))
    # Residuals, best-fit decreasing over runs of equal open sequences: space left -> [(pattern so far, how many)].
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(pattern: tuple[int, ...], times: int, space: int) -> None:
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((pattern, times))

    for size in range(capacity, 0, -1):
        count = int(left[size])
        while count:
            i = bisect_right(spaces, size - 1)
            if i < len(spaces):
                space = spaces[i]
                pattern, times = room[space].pop()
                if not room[space]:
                    del room[space], spaces[i]
            else:
                each = capacity // size
                full, rest = divmod(count, each)
                if full:
                    put((size,) * each, full, capacity - each * size)
                if rest:
                    put((size,) * rest, 1, capacity - rest * size)
                break
            fits = space // size
            full = min(times, count // fits)
            if full:
                put(pattern + (size,) * fits, full, space - fits * size)
                count -= full * fits
            if times > full and 0 < count < fits:
                put(pattern + (size,) * count, 1, space - count * size)
                full, count = full + 1, 0
            if times > full:
                put(pattern, times - full, space)
    return plan + [(p, t) for s in spaces for p, t in room[s]]


def places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of ranks."""
    used, first, out = np.zeros(capacity + 1, np.int64), 0, {}
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            out.setdefault(size, []).append((int(used[size]), first, offset))
            used[size] += times
            offset += size
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, **how) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cutted = cut(pieces(df, key, text, capacity, **how), "pieces")
    counts = cutted.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r.length] = r.n
    where = places(plan_sequences(hist, capacity), capacity)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    kind = df.schema[key].dataType.simpleString()

    def place(batches):
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                ranks, seqs, offs = where[int(s)]
                at = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own], offset[own] = seqs[at] + rank[own] - ranks[at], offs[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cutted.join(before, ["part", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", key)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
