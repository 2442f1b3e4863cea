"""Document quality by Bradley-Terry pairwise ranking (operator 3).

From all labelled documents outside the held-out fold, all preference pairs (a good document over a bad one) count;
weights of text features are learnt by logistic loss on the feature differences (Newton steps, L2). Pairs are not written
out: documents of a label whose scores lie within WIDE meet those of the other label as one, by their count, their sum of
features and their sum of squares, which is one pass over the written features a step. Features are shares that hold for any prose: letters, marks, digits, byte entropy, short words, repeated words, lines and
word triples. Each labelled document takes part as a whole and by two excerpts of one to twenty words, excerpts being
paired with excerpts, so that short texts are judged by what was learnt on short ones. A document's raw score is its
weighted feature sum. The cut is a quantile of all their raw scores, the one that separates the labels best, from counts by
bins of NARROW; the score is the logistic function of the distance to it, shifted so that the cut lies at the decision threshold. Only the text is
an input of a score, and the whole of it. Features and weights are rounded to binary fractions whose sums are exact, so that
the model does not depend on the order of tasks.

null text: as the empty text, whose features are all zero; like one or two words it says little, and is drawn to the
middle. Without labels of both kinds nothing can be learnt: every score is 1. An id with conflicting labels
teaches nothing; of rows that repeat an id the longest is learnt from, by a hash if alike. Repeated rows are scored each. Ties of
quantiles: the middle one. Columns named score or predicted are replaced by rate(), further ones stay. Empty table: no
rows. A null doc_id is in no fold: scored, not held out.
"""

from __future__ import annotations

import zlib
from math import log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, drop, fold, may_hold, table

SENTENCE = b".,;:?!'\"()-"
FEATURES = ("words", "types", "repeats", "triples", "short_words", "upper", "digits", "letters", "marks", "sentence", "odd_ends", "bytes_a_word", "lines", "same_lines", "entropy", "high")
#: Steps of standardised features and of weights. Widths of the bins of scores in which documents meet, and of those that place the cut. Scores beyond FAR count as that far.
UNIT, FINE, WIDE, NARROW, FAR = 1 << 12, 1 << 20, 0.25, 1 / 1024, 64
#: Classes of bytes: letters (all of other scripts among them), digits, white space, sentence marks, other marks.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
MARKS = np.array([32 < b < 127 and not chr(b).isalnum() and b not in SENTENCE for b in range(256)])
ODD = frozenset(chr(b) for b in np.flatnonzero(MARKS))


def features_of(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words, raw = text.split(), np.frombuffer(text.encode(), np.uint8)
    if not words:
        return (0.0,) * len(FEATURES)
    count = np.bincount(raw, minlength=256)
    n, size, lines = len(words), len(raw), text.split("\n")
    share = count[count > 0] / size
    return (
        log1p(n),
        log1p(len(set(words))) / log1p(n),
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 0.0,
        sum(len(w) <= 3 for w in words) / n,
        float(count[65:91].sum()) / size,
        float(count[48:58].sum()) / size,
        float(count[LETTERS].sum()) / size,
        float(count[MARKS].sum()) / size,
        float(count[list(SENTENCE)].sum()) / size,
        sum(w[-1] in ODD for w in words) / n,
        log1p(size / n),
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()) / log1p(min(size, 1000)),
        float(count[128:].sum()) / size,
    )


def excerpts(text: str | None) -> list[str]:
    """Two runs of one to twenty words of a text of more words than that, each the same every time."""
    words, mixed = (text or "").split(), zlib.crc32((text or "").encode())
    if len(words) <= 20:
        return []
    return [" ".join(words[at : at + 1 + mixed % size]) for at, size in ((mixed % (len(words) - 20), 20), (mixed // 7 % (len(words) - 20), 8))]


def expand(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares, so that too little and too much can both count. One or two words say little: their features are drawn to the middle."""
    n = np.expm1(x[:, :1])
    z = np.clip((x - middle) / spread, -8, 8) * n / (n + 2)
    return np.rint(np.concatenate([z, z * z / 4], axis=1) * UNIT) / UNIT


class PairwiseRanker:
    """By its constructor of drawn pairs of rows in memory; fit() makes one of all pairs."""

    @classmethod
    def of(cls, middle: np.ndarray, spread: np.ndarray, w: np.ndarray, cut: float, scale: float, threshold: float) -> PairwiseRanker:
        out = cls.__new__(cls)
        out.middle, out.spread, out.w, out.cut, out.scale, out.shift = middle, spread, w, cut, max(1e-6, scale), log(threshold / (1 - threshold))
        return out

    def __init__(self, x: np.ndarray, y: np.ndarray, threshold: float, part: np.ndarray | None = None, pairs: int = 20_000, l2: float = 1e-3, seed: int = 3):
        """part: whether a row is an excerpt; excerpts are paired with excerpts and have no say in the cut."""
        part = np.zeros(len(y), bool) if part is None else part
        self.middle, self.spread = np.median(x[~part], axis=0), x.std(axis=0) + 1e-6
        z, rng = expand(x, self.middle, self.spread), np.random.default_rng(seed)
        drawn = []
        for own in (~part, part):
            good, bad = np.flatnonzero(own & (y == 1)), np.flatnonzero(own & (y == 0))
            if len(good) and len(bad):
                drawn.append(z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)])
        d = np.concatenate(drawn)
        pairs, w = len(d), np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the wrong order
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w)), d.T @ p / pairs - l2 * w)
            w += step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        s = z[~part] @ w
        good, bad = np.flatnonzero(y[~part] == 1), np.flatnonzero(y[~part] == 0)
        levels = np.linspace(0.002, 0.998, 499)
        cuts = np.quantile(s, levels)
        right = [((s[good] >= c).mean() + (s[bad] < c).mean()) for c in cuts]
        best = np.flatnonzero(np.isclose(right, max(right), atol=1e-3))
        self.level = float(levels[best[len(best) // 2]])
        below, above = s[s < np.quantile(s, self.level)], s[s >= np.quantile(s, self.level)]
        # in the middle of the gap at that quantile, nearer to the bad side, as clean documents are to stay
        top, bottom = (below.max() if len(below) else above.min() - 1), above.min()
        self.cut = top + 0.3 * (bottom - top)
        self.scale = max(1e-6, float(np.median(s[good]) - self.cut) / 3)
        self.shift = log(threshold / (1 - threshold))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((expand(x, self.middle, self.spread) @ self.w - self.cut) / self.scale + self.shift, -30, 30)))


def _described(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(y, x) of each known document: the features of the whole and, after them, of its excerpts; a written table."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "rank": b["rank"], "x": [np.array([features_of(part) for part in (t, *excerpts(t))]).ravel() for t in b["text"]]})

    rank = F.array(F.coalesce(F.length(text), F.lit(0)).cast("long"), F.xxhash64(text)).alias("rank")
    some = may_hold(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), rank), known, "id")
    found = some.mapInPandas(each, f"id {kind}, rank array<long>, x array<double>").join(known, "id")
    return cut(found.groupBy("id").agg(F.max_by(F.struct("y", "x"), "rank").alias("r")).select("r.y", "r.x"), "features")


def _rows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label, and whether it is an excerpt: a row for each of a document's."""
    sizes = np.array([len(x) // len(FEATURES) for x in batch["x"]])
    part = np.ones(sizes.sum(), bool)
    part[np.cumsum(sizes) - sizes] = False
    return np.concatenate(batch["x"].tolist()).reshape(-1, len(FEATURES)), np.repeat(batch["y"].to_numpy(), sizes), part


def _middle_and_spread(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature the median of whole documents and the deviation of all rows, from counts by the leading bits of its values (a five-hundredth apart)."""

    def each(batches):
        for b in batches:
            x, _, part = _rows(b)
            for f in range(x.shape[1]):
                v = x[:, f] + 0.0  # no negative zero
                yield pd.DataFrame({"f": f, "part": part, "bin": v.view(np.int64) >> 43, "v": v}).groupby(["f", "part", "bin"], as_index=False).agg(n=("v", "size"), lo=("v", "min"), hi=("v", "max"))

    found = known.mapInPandas(each, "f int, part boolean, bin long, n long, lo double, hi double").groupBy("f", "part", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = found.toPandas().assign(v=lambda t: (t["lo"] + t["hi"]) / 2).sort_values(["f", "v", "part"])
    middle, spread = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    for f, t in found.groupby("f"):
        whole = t[~t["part"].astype(bool)]
        middle[f] = whole["v"].to_numpy()[np.searchsorted(whole["n"].cumsum(), whole["n"].sum() / 2)]
        mean = np.average(t["v"], weights=t["n"])
        spread[f] = np.sqrt(np.average((t["v"] - mean) ** 2, weights=t["n"])) + 1e-6
    return middle, spread


def _moments(known: DataFrame, middle: np.ndarray, spread: np.ndarray, w: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By (excerpt, label): counts, sums and sums of products of features, a row for each bin of scores. Whole numbers, so any order of tasks gives the same."""
    size, half = 2 * len(FEATURES), int(FAR / WIDE)
    upper = np.triu_indices(size)

    def each(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, part = _rows(b)
            z = expand(x, middle, spread)
            at = np.clip(np.floor(z @ w / WIDE), -half, half - 1).astype(int) + half + 2 * half * (2 * part + y)
            order = np.argsort(at, kind="stable")
            z, at = z[order] * UNIT, at[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            for a, e in zip(starts, [*starts[1:], len(at)], strict=True):
                v = z[a:e]
                total[at[a]] = total.get(at[a], 0) + np.r_[e - a, v.sum(axis=0), (v.T @ v)[upper]].astype(np.int64)
        yield pd.DataFrame({"slot": list(total), "sums": [v.tobytes() for v in total.values()]}).astype({"slot": "int32"})

    def added(t):
        return pd.DataFrame({"slot": t["slot"].iloc[:1], "sums": [np.sum([np.frombuffer(v, np.int64) for v in t["sums"]], axis=0).tobytes()]})

    found = known.mapInPandas(each, "slot int, sums binary").groupBy("slot").applyInPandas(added, "slot int, sums binary").toPandas().sort_values("slot")
    out = {}
    for own, t in found.groupby(found["slot"] // (2 * half)):
        sums = np.array([np.frombuffer(v, np.int64) for v in t["sums"]]).astype(float)
        products = np.zeros((len(sums), size, size))
        products[:, upper[0], upper[1]] = products[:, upper[1], upper[0]] = sums[:, 1 + size :] / UNIT**2
        out[divmod(int(own), 2)] = sums[:, 0], sums[:, 1 : 1 + size] / UNIT, products
    return out


def _slope(known: DataFrame, middle: np.ndarray, spread: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negative curvature of the mean log-likelihood of all pairs' order, pairs of excerpts weighing as much as pairs of documents."""
    sums, slopes = _moments(known, middle, spread, w), []
    for part in (0, 1):
        if (part, 1) in sums and (part, 0) in sums:
            (n, s, q), (m, t, r) = sums[part, 1], sums[part, 0]
            p = 1 / (1 + np.exp(np.clip((s @ w / n)[:, None] - t @ w / m, -30, 30)))  # probability of the wrong order
            h, pairs = p * (1 - p), n.sum() * m.sum()
            cross = s.T @ h @ t
            slopes.append((((p @ m) @ s - (n @ p) @ t) / pairs, (np.tensordot(h @ m, q, 1) + np.tensordot(n @ h, r, 1) - cross - cross.T) / pairs))
    return sum(a for a, _ in slopes) / len(slopes), sum(b for _, b in slopes) / len(slopes)


def _cut_and_scale(known: DataFrame, middle: np.ndarray, spread: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Where the quantile of all documents' raw scores lies that separates the labels best, and a third of what the median of good ones lies above it."""

    def each(batches):
        for b in batches:
            x, y, part = _rows(b)
            s = expand(x[~part], middle, spread) @ w
            yield pd.DataFrame({"bin": np.clip(np.floor(s / NARROW), -FAR / NARROW, FAR / NARROW).astype(int), "good": y[~part], "s": s}).groupby("bin", as_index=False).agg(n=("s", "size"), good=("good", "sum"), lo=("s", "min"), hi=("s", "max"))

    found = known.mapInPandas(each, "bin long, n long, good long, lo double, hi double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = found.toPandas().sort_values("bin")
    n, good, lo, hi = (found[c].to_numpy() for c in ("n", "good", "lo", "hi"))
    at = np.searchsorted(np.cumsum(n), np.linspace(0.002, 0.998, 499) * n.sum())
    right = 1 - (np.cumsum(good) - good)[at] / good.sum() + (np.cumsum(n - good) - (n - good))[at] / (n - good).sum()
    best = np.flatnonzero(np.isclose(right, right.max(), atol=1e-3))
    k = at[best[len(best) // 2]]
    # in the middle of the gap at that quantile, nearer to the bad side, as clean documents are to stay
    top, bottom = hi[k - 1] if k else lo[k] - 1, lo[k]
    place, median = top + 0.3 * (bottom - top), np.searchsorted(np.cumsum(good), good.sum() / 2)
    return float(place), float((lo[median] + hi[median]) / 2 - place) / 3


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, l2: float = 1e-3) -> PairwiseRanker | None:
    """Learns from all labelled documents outside the held-out fold; None without both labels."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where((fold("id", folds) != held) & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = cut(known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y"), "known")
    rows = _described(docs, known, key, text)
    drop(known)
    if rows.agg(F.count_distinct("y")).first()[0] < 2:
        drop(rows)
        return None
    middle, spread = _middle_and_spread(rows)
    w = np.zeros(2 * len(FEATURES))
    for _ in range(25):
        up, curve = _slope(rows, middle, spread, w)
        step = np.linalg.solve(curve + l2 * np.eye(len(w)), up - l2 * w)
        w = np.rint((w + step / max(1.0, np.abs(step).max() / 2)) * FINE) / FINE
        if np.abs(step).max() < 1e-3:
            break
    place, scale = _cut_and_scale(rows, middle, spread, w)
    drop(rows)
    return PairwiseRanker.of(middle, spread, w, place, scale, threshold)


def score(text: Column, model: PairwiseRanker | None) -> Column:
    @pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.ones(len(texts)))
        return pd.Series(model.score(np.array([features_of(t) for t in texts])))

    return scores(text)


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with score and predicted (1: kept)."""
    model = fit(docs, labels, threshold, key=key, text=text, **how)
    return docs.withColumn("score", score(F.col(text), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return rate(docs, labels).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
