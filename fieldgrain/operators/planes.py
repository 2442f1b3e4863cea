"""Planes as pixel relations (image, y, x, v): for checks, small images, and sums over many. Whole planes go through the image tier."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels


def pixels(df: DataFrame, image: str, plane: str, width: int, *keep: str) -> DataFrame:
    """A row per pixel of a row-major array column."""
    return df.select(F.col(image).alias("image"), *keep, F.posexplode(plane).alias("i", "v")).select("image", *keep, F.expr(f"i div {width}").cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def rescale(px: DataFrame) -> DataFrame:
    """v to [0, 1] by the image's own range unless it lies there already; flat images elsewhere give 0."""
    span = px.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when((F.col("lo") >= 0) & (F.col("hi") <= 1), F.col("v")).when(F.col("hi") <= F.col("lo"), 0.0).otherwise((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return px.join(span, "image").withColumn("v", v).drop("lo", "hi")


def stretch(px: DataFrame, low: float = 1.0, high: float = 99.5) -> DataFrame:
    """Linear between two exact percentiles of each image, clipped."""
    span = px.groupBy("image").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    return px.join(span, "image").withColumn("v", F.when(hi <= lo, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - lo) / (hi - lo))))).drop("p")


def luminance(rgb: DataFrame) -> DataFrame:
    """(image, y, x, r, g, b) to v."""
    r, g, b = kernels.LUMINANCE
    return rgb.select("image", "y", "x", (r * F.col("r") + g * F.col("g") + b * F.col("b")).alias("v"))


def projection(px: DataFrame, stack: str) -> DataFrame:
    """The maximum over the images of each stack."""
    return px.groupBy(F.col(stack).alias("image"), "y", "x").agg(F.max("v").alias("v"))


def histogram(px: DataFrame, bins: int = 256) -> DataFrame:
    """(image, bin, n, lo, hi): counts over the image's range, the last bin closed; flat images have none."""
    span = px.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return px.join(span, "image").groupBy("image", at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def _centre(at, bins: int = 256):
    return F.col("lo") + (at + 0.5) * (F.col("hi") - F.col("lo")) / bins


def _first_best(df: DataFrame, score) -> DataFrame:
    """The bin of the greatest score, of equal ones the first."""
    return df.groupBy("image", "lo", "hi").agg(F.max_by("bin", F.struct(score, -F.col("bin"))).alias("bin")).select("image", _centre(F.col("bin")).alias("threshold"))


def otsu(px: DataFrame) -> DataFrame:
    """(image, threshold): greatest variance between the classes of a 256-bin histogram; sums are exact integers."""
    w = Window.partitionBy("image").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("image")
    h = histogram(px).withColumns({"w1": F.sum("n").over(w), "s1": F.sum(F.col("n") * F.col("bin")).over(w), "total": F.sum("n").over(all_), "sum": F.sum(F.col("n") * F.col("bin")).over(all_)})
    w2, s2 = F.col("total") - F.col("w1"), F.col("sum") - F.col("s1")
    return _first_best(h.where("w1 < total"), F.col("w1") * w2 * F.pow(F.col("s1") / F.col("w1") - s2 / w2, 2))


def yen(px: DataFrame) -> DataFrame:
    """(image, threshold): maximum correlation criterion on the same histogram."""
    w = Window.partitionBy("image").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("image")
    h = histogram(px).withColumns({"c": F.sum("n").over(w), "a": F.sum(F.col("n") * F.col("n")).over(w), "total": F.sum("n").over(all_), "q": F.sum(F.col("n") * F.col("n")).over(all_)})
    left = F.col("c") * (F.col("total") - F.col("c"))
    return _first_best(h.where("c < total"), F.log(left * left / (F.col("a") * (F.col("q") - F.col("a")))))


def triangle(px: DataFrame) -> DataFrame:
    """(image, threshold): the bin deepest below the chord from the peak to the end of the longer tail; of equal ones the farthest from the peak."""
    h = histogram(px)
    ends = h.groupBy("image", "lo", "hi").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak"), F.max("n").alias("top"), F.min_by("n", "bin").alias("n_first"), F.max_by("n", "bin").alias("n_last"))
    left = F.col("peak") - F.col("first") >= F.col("last") - F.col("peak")
    ends = ends.withColumns({"end": F.when(left, F.col("first")).otherwise(F.col("last")), "n_end": F.when(left, F.col("n_first")).otherwise(F.col("n_last"))})
    between = ends.withColumn("bin", F.explode(F.sequence(F.least("peak", "end"), F.greatest("peak", "end"))))
    filled = between.join(h.select("image", "bin", "n"), ["image", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    depth = F.when(F.col("peak") == F.col("end"), 0.0).otherwise((F.col("bin") - F.col("end")) * (F.col("top") - F.col("n_end")) / (F.col("peak") - F.col("end")) + F.col("n_end") - F.col("n"))
    return filled.groupBy("image", "lo", "hi").agg(F.max_by("bin", F.struct(depth, -F.abs(F.col("bin") - F.col("end")))).alias("bin")).select("image", _centre(F.col("bin")).alias("threshold"))


THRESHOLDS = {"otsu": otsu, "yen": yen, "triangle": triangle}


def foreground(px: DataFrame, thresholds: DataFrame) -> DataFrame:
    """px with `on`: strictly above the image's threshold; an image without a threshold has no foreground."""
    return px.join(thresholds, "image", "left").withColumn("on", F.coalesce(F.col("v") > F.col("threshold"), F.lit(False))).drop("threshold")


def by_kernel(df: DataFrame, image: str, plane: str, width: int, kernel, out: str = "double") -> DataFrame:
    """(image, y, x, v) of kernel(2-D array) for each row's array column."""
    kind = df.schema[image].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = []
            for i, p in zip(b["image"], b["plane"], strict=True):
                a = np.asarray(kernel(np.asarray(p, np.float64).reshape(-1, width)))
                y, x = np.divmod(np.arange(a.size), width)
                parts.append(pd.DataFrame({"image": i, "y": y, "x": x, "v": a.ravel()}))
            if parts:
                yield pd.concat(parts)

    return df.select(F.col(image).alias("image"), F.col(plane).alias("plane")).mapInPandas(run, f"image {kind}, y int, x int, v {out}")
