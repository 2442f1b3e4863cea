"""Marker intensity per object, thresholds over objects, and the summary of a two-channel experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

INF = float("inf")


def object_means(px: DataFrame) -> DataFrame:
    """(image, label, m) to marker_mean and marker_max per object, times 255."""
    return px.where("label > 0").groupBy("image", F.col("label").cast("long").alias("object_id")).agg((F.avg("m") * 255).alias("marker_mean"), (F.max("m") * 255).alias("marker_max"))


def exact_otsu(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, threshold) over all splits between distinct values; the middle of the first best split's two values, infinity for under three or equal values.

    Equal values are counted before the sort, and sums are running sums, so a group costs n log n and ships each distinct value once.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy("v")
    upto, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    run = each.select(by, "v", F.lead("v").over(w).alias("next"), F.sum("n").over(upto).alias("below"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s"), F.sum("n").over(all_).alias("total"), F.sum(F.col("n") * F.col("v")).over(all_).alias("all"), (F.max("v").over(all_) - F.min("v").over(all_)).alias("span"))
    above = F.col("total") - F.col("below")
    gap = F.col("s") / F.col("below") - (F.col("all") - F.col("s")) / above
    variance = F.col("below") / F.col("total") * (above / F.col("total")) * gap * gap
    # Splits that differ by rounding alone are equal: variances are compared in units of the squared range, whatever the scale.
    best = run.where("next is not null and total >= 3").groupBy(by).agg(F.max_by((F.col("v") + F.col("next")) / 2, F.struct(F.round(variance / (F.col("span") * F.col("span")), 9), -F.col("v"))).alias("threshold"))
    return each.select(by).distinct().join(best, by, "left").fillna(INF, ["threshold"])


#: Methods by name.
METHODS = ("otsu", "manual", "mixture")


def choose_thresholds(df: DataFrame, by: str, value: str, method: str = "otsu", manual: float | None = None) -> DataFrame:
    """(by, threshold) of a method by its name; infinity where a group has nothing to call. manual needs a value, unknown names are errors."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if method == "manual":
        if manual is None:
            raise ValueError("a manual threshold needs a value")
        return df.select(by).distinct().withColumn("threshold", F.lit(float(manual)))
    if method == "otsu":
        return exact_otsu(df, by, value)
    from .positivity import mixture_calls

    return mixture_calls(df, by, value).select(F.col("g").alias(by), "threshold")


def call(objects: DataFrame, thresholds: DataFrame, by: str, value: str = "marker_mean") -> DataFrame:
    """objects with marker_positive: at or above the group's threshold (broadcast only if the optimizer finds it small)."""
    return objects.join(thresholds.select(by, "threshold"), by, "left").withColumn("marker_positive", F.coalesce(F.col(value) >= F.col("threshold"), F.lit(False)))


def separation(lo_pos, hi_neg, lo, hi):
    """The empty gap between the groups as a share of the range; null if one is empty."""
    return F.when(lo_pos.isNull() | hi_neg.isNull(), None).when(hi <= lo, 0.0).otherwise(F.greatest(F.lit(0.0), (lo_pos - hi_neg) / (hi - lo)))


def summarize(images: DataFrame, called: DataFrame, by: str, value: str = "marker_mean") -> DataFrame:
    """A row per image, also without objects: total, positive, negative, percent_positive, threshold, means, separation."""
    pos, v = F.col("marker_positive"), F.col(value)
    g = called.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(pos).alias("positive"), F.max("threshold").alias("threshold"), F.avg(F.when(pos, v)).alias("mean_positive_intensity"), F.avg(F.when(~pos, v)).alias("mean_negative_intensity"),
        separation(F.min(F.when(pos, v)), F.max(F.when(~pos, v)), F.min(v), F.max(v)).alias("separation"),
    )
    out = images.select(by).distinct().join(g, by, "left").fillna(0, ["total", "positive"])
    return out.withColumns({"negative": F.col("total") - F.col("positive"), "percent_positive": C.ratio(100 * F.col("positive"), F.col("total"))})
