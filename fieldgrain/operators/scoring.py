"""Predicted against true label planes: overlaps, assignment, errors by threshold, and figures of a dataset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import codecs, kernels

#: Thresholds in percent; the share of a true object that an overlap must have to claim it.
PERCENTS, CLAIM = tuple(range(50, 100, 5)), 0.25


def decode_colours(a: np.ndarray) -> np.ndarray:
    """Objects of a coloured mask: components within each non-zero colour, numbered colour after colour."""
    a = a[..., 0] if a.ndim == 3 else a
    parts = kernels.components(a)
    names = [parts[a == c] for c in np.unique(a[a != 0])]
    order = [n for x in names for n in np.unique(x)]
    lut = np.zeros(int(parts.max(initial=0)) + 1, np.int32)
    lut[order] = np.arange(1, len(order) + 1)
    return lut[parts]


def held_against(analyzed: DataFrame, masks: DataFrame, keep: str = "path", mask: str = "mask", least: int = 0) -> DataFrame:
    """Analysed images (with planes) and coloured masks of the same key to a row per image and parameter set: image, params, n_pred, n_true, pairs. Images without a mask, with an error or a mask of another size drop out. least: smaller true objects are left out."""
    kind = analyzed.schema[keep].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for key, params, width, height, plane, raw in zip(b["image"], b["params"], b["width"], b["height"], b["plane"], b["mask"], strict=True):
                true = kernels.relabel(kernels.drop_small(decode_colours(codecs.read(bytes(raw))[0]), least))
                if true.shape != (height, width):
                    continue
                pred = np.frombuffer(plane, "<i4").reshape(height, width)
                both, n = np.unique(np.stack([pred[(pred > 0) & (true > 0)], true[(pred > 0) & (true > 0)]]), axis=1, return_counts=True)
                areas = np.bincount(pred.ravel()), np.bincount(true.ravel())
                pairs = [{"pred": p, "truth": t, "n": k, "iou": k / (areas[0][p] + areas[1][t] - k), "truth_area": areas[1][t]} for p, t, k in zip(*both.tolist(), n.tolist(), strict=True)]
                rows.append((key, params, int(pred.max(initial=0)), int(true.max(initial=0)), pairs))
            if rows:
                yield pd.DataFrame(rows, columns=["image", "params", "n_pred", "n_true", "pairs"])

    both = analyzed.where("label_plane is not null").join(masks.select(keep, F.col(mask).alias("mask")), keep)
    return both.select(F.col(keep).alias("image"), "params", "width", "height", F.col("label_plane").alias("plane"), "mask").mapInPandas(run, f"image {kind}, params string, n_pred int, n_true int, pairs array<struct<pred:int,truth:int,n:long,iou:double,truth_area:long>>")


def score_sets(held: DataFrame) -> DataFrame:
    """What held_against() makes to a row of figures per parameter set: images, counts and their error, F1 at 50 percent, mean F1, splits and merges. Totals over images come first, ratios after."""
    one = held.withColumn("image", F.concat_ws("#", "params", "image"))
    counts, pairs = one.select("image", "params", "n_pred", "n_true"), one.select("image", F.explode("pairs").alias("p")).select("image", "p.*")
    wrong, by = split_merge(pairs, counts), by_threshold(matched(pairs), counts)
    f1 = by.join(counts.select("image", "params"), "image").groupBy("params", "percent").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = f1.withColumn("f1", C.f1(F.col("tp"), F.col("fp"), F.col("fn"))).groupBy("params").agg(F.max(F.when(F.col("percent") == 50, F.col("f1"))).alias("f1_50"), F.avg("f1").alias("mean_f1"))
    n = counts.join(wrong, "image").groupBy("params").agg(F.count("*").alias("images"), F.sum("n_pred").alias("predicted"), F.sum("n_true").alias("true_objects"), F.sum(F.col("n_pred") - F.col("n_true")).alias("count_error"), F.sum("split").alias("split_errors"), F.sum("merge").alias("merge_errors"))
    return n.join(f1, "params")


def joint(px: DataFrame) -> DataFrame:
    """(image, pred, truth) labels per pixel to (image, pred, truth, n), background with them: the only pass over the pixels, sparse however many objects. An image's rows are in one partition, so that all that follows needs no further shuffle."""
    return px.groupBy("image", "pred", "truth").agg(F.count("*").alias("n")).repartition("image")


def overlaps(px: DataFrame) -> DataFrame:
    """joint() without background."""
    return joint(px).where("pred > 0 and truth > 0")


def ious(px: DataFrame) -> DataFrame:
    """(image, pred, truth, n, pred_area, truth_area, iou) of every overlapping pair."""
    area = lambda c: F.sum("n").over(Window.partitionBy("image", c))
    whole = joint(px).withColumns({"pred_area": area("pred"), "truth_area": area("truth")}).where("pred > 0 and truth > 0")
    return whole.withColumn("iou", F.col("n") / (F.col("pred_area") + F.col("truth_area") - F.col("n")))


def matched(pairs: DataFrame, image: str = "image") -> DataFrame:
    """(image, pred, truth, iou): the pairs of greatest total IoU. Pairs that don't overlap add nothing, so only overlapping ones are dealt with, and each connected part of them apart."""
    kind = pairs.schema[image].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pred", "truth"])
        (pred, p), (true, t) = (np.unique(frame[c], return_inverse=True) for c in ("pred", "truth"))
        part = np.arange(len(pred))
        while True:  # the least row index that each part reaches
            low = np.full(len(true), len(pred))
            np.minimum.at(low, t, part[p])
            new = part.copy()
            np.minimum.at(new, p, low[t])
            if (new == part).all():
                break
            part = new
        rows, iou = [], frame["iou"].to_numpy()
        for c in np.unique(part):
            own = np.flatnonzero(part[p] == c)
            (a, i), (b, j) = np.unique(p[own], return_inverse=True), np.unique(t[own], return_inverse=True)
            gain = np.zeros((len(a), len(b)))
            gain[i, j] = iou[own]
            rows += [(pred[a[x]], true[b[y]], gain[x, y]) for x, y in kernels.assign(gain) if gain[x, y] > 0]
        out = pd.DataFrame(rows, columns=["pred", "truth", "iou"])
        out.insert(0, image, frame[image].iloc[0])
        return out

    return pairs.select(image, "pred", "truth", "iou").groupBy(image).applyInPandas(solve, f"`{image}` {kind}, pred int, truth int, iou double")


def object_counts(px: DataFrame) -> DataFrame:
    """(image, n_pred, n_true), also of images without objects."""
    there = lambda c: F.size(F.collect_set(F.when(F.col(c) > 0, F.col(c))))
    return joint(px).groupBy("image").agg(there("pred").cast("long").alias("n_pred"), there("truth").cast("long").alias("n_true"))


def count_errors(counts: DataFrame) -> DataFrame:
    """counts with the signed error: too many objects are positive, too few negative."""
    return counts.withColumn("count_error", F.col("n_pred") - F.col("n_true"))


def split_merge(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(image, split, merge): true objects claimed twice or more, predictions that claim two or more."""
    claims = pairs.where(F.col("n") >= CLAIM * F.col("truth_area"))
    many = lambda c, name: claims.groupBy("image", c).agg(F.count("*").alias("k")).where("k >= 2").groupBy("image").agg(F.count("*").alias(name))
    return counts.select("image").join(many("truth", "split"), "image", "left").join(many("pred", "merge"), "image", "left").fillna(0, ["split", "merge"])


def by_threshold(matches: DataFrame, counts: DataFrame, image: str = "image") -> DataFrame:
    """(image, percent, tp, fp, fn): matches at or above each threshold."""
    n = matches.groupBy(image).agg(*[F.count_if(F.col("iou") >= p / 100).alias(f"t{p}") for p in PERCENTS])
    long = counts.join(n, image, "left").select(image, "n_pred", "n_true", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.coalesce(f"t{p}", F.lit(0)).alias("tp")) for p in PERCENTS])).alias("s"))
    return long.select(image, "s.percent", "s.tp", (F.col("n_pred") - F.col("s.tp")).alias("fp"), (F.col("n_true") - F.col("s.tp")).alias("fn"))


def dataset(matches: DataFrame, errors: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of figures: totals over all images at each threshold first, ratios after. matches, errors (split, merge) and counts meet once, per image."""
    hits = matches.groupBy("image").agg(F.count("*").alias("n"), F.sum("iou").alias("iou"), *[F.count_if(F.col("iou") >= p / 100).alias(f"t{p}") for p in PERCENTS])
    each = counts.join(hits, "image", "left").join(errors, "image", "left")
    total = each.agg(
        F.count("*").alias("images"), F.sum("n_pred").alias("predicted"), F.sum("n_true").alias("true_objects"), F.sum(F.col("n_pred") - F.col("n_true")).alias("count_error"),
        F.avg(F.when(F.col("n_true") > 0, F.abs(F.col("n_pred") - F.col("n_true")) / F.col("n_true"))).alias("count_mape"), C.ratio(F.sum("iou"), F.sum("n")).alias("mean_matched_iou"),
        F.sum("split").alias("split_errors"), F.sum("merge").alias("merge_errors"), *[F.coalesce(F.sum(f"t{p}"), F.lit(0)).alias(f"t{p}") for p in PERCENTS],
    )
    at = {p: (F.col(f"t{p}"), F.col("predicted") - F.col(f"t{p}"), F.col("true_objects") - F.col(f"t{p}")) for p in PERCENTS}
    share = lambda part, *rest: F.coalesce(C.ratio(part, sum(rest, part)), F.lit(0.0))
    mean = lambda of: sum(of(*v) for v in at.values()) / len(at)
    tp, fp, fn = at[50]
    figures = {"f1_50": C.f1(tp, fp, fn), "precision_50": share(tp, fp), "recall_50": share(tp, fn), "f1_75": C.f1(*at[75]), "average_precision": mean(share), "mean_f1": mean(C.f1)}
    return total.withColumns(figures).drop(*[f"t{p}" for p in PERCENTS])


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, rho): correlation of ordinal ranks; of equal y the one with the lesser x ranks first. Null if a side is constant."""
    w = lambda *c: Window.partitionBy(by).orderBy(*c)
    ranks = df.select(by, F.row_number().over(w(x, y)).cast("double").alias("rx"), F.row_number().over(w(y, x)).cast("double").alias("ry"))
    return ranks.groupBy(by).agg(F.when(F.count("*") > 1, F.corr("rx", "ry")).alias("rho"))
