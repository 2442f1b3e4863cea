"""Is there a positive population, and where does it begin: mixture, negative-control and manual calls per group.

Groups are pre-aggregated to distinct values with counts before they meet in a task, so the fits see each value once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

INF = float("inf")
#: Most rounds of a fit, relative change of the likelihood that ends it.
ROUNDS, TOLERANCE = 200, 1e-6


def counted(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def weighted_median(v: np.ndarray, n: np.ndarray) -> float:
    """Median of sorted v repeated n times."""
    ends, half = np.cumsum(n), n.sum() / 2
    low = v[np.searchsorted(ends, half, side="left")]
    return float((low + v[np.searchsorted(ends, half, side="right")]) / 2) if half in ends else float(low)


def halves(v: np.ndarray, n: np.ndarray) -> np.ndarray | None:
    """Which values are in the low half: up to the median, or the mean if the median leaves one side empty."""
    for split in (weighted_median(v, n), float(np.average(v, weights=n))):
        low = v <= split
        if low.any() and not low.all():
            return low
    return None


def two_normals(v: np.ndarray, n: np.ndarray, trace: list | None = None) -> dict | None:
    """Two weighted normals by expectation maximisation from a median split; the likelihood is that of the round before the last update. trace: gets (likelihood, means after it) of each round."""
    low = halves(v, n)
    if low is None:
        return None
    side = np.stack([low, ~low]).astype(float)
    total = n.sum()

    def update(share):
        size = np.maximum((share * n).sum(axis=1), 1e-12)
        mean = (share * n * v).sum(axis=1) / size
        var = (share * n * (v - mean[:, None]) ** 2).sum(axis=1) / size
        return size / total, mean, np.sqrt(np.maximum(var, C.LEAST_SIGMA**2))

    weight, mean, sigma = update(side)
    before = -INF
    for _ in range(ROUNDS):
        parts = np.log(weight)[:, None] - 0.5 * ((v - mean[:, None]) / sigma[:, None]) ** 2 - np.log(sigma)[:, None] - 0.5 * np.log(2 * np.pi)
        both = np.logaddexp(*parts)
        now = float((n * both).sum())
        weight, mean, sigma = update(np.exp(parts - both))
        if trace is not None:
            trace.append((now, *mean.tolist()))
        if abs(now - before) < TOLERANCE * max(1.0, abs(before)):
            break
        before = now
    a, b = np.argsort(mean, kind="stable")
    return {"w0": weight[a], "w1": weight[b], "m0": mean[a], "m1": mean[b], "s0": sigma[a], "s1": sigma[b], "ll2": now}


FIT = ("w0", "w1", "m0", "m1", "s0", "s1", "ll2")


def fits(df: DataFrame, by: str, value: str) -> DataFrame:
    """A row per group: g, n, lo, hi, mean, sigma, ll1, and the two-component fit (nulls where there is none)."""
    each = counted(df, by, value)
    kind = each.schema["g"].dataType.simpleString()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        v, n = frame["v"].to_numpy(), frame["n"].to_numpy().astype(float)
        total, mean = n.sum(), float(np.average(v, weights=n))
        var = float(np.average((v - mean) ** 2, weights=n))
        sigma = max(var**0.5, C.LEAST_SIGMA)
        ll1 = -total * (np.log(sigma) + 0.5 * np.log(2 * np.pi)) - total * var / (2 * sigma**2)
        two = two_normals(v, n) if total >= 3 and v[0] < v[-1] else None
        return pd.DataFrame([{"g": frame["g"].iloc[0], "n": int(total), "lo": v[0], "hi": v[-1], "mean": mean, "sigma": sigma, "ll1": ll1, **(two or dict.fromkeys(FIT))}]).astype({k: float for k in FIT})

    return each.groupBy("g").applyInPandas(fit, f"g {kind}, n long, lo double, hi double, mean double, sigma double, ll1 double, " + ", ".join(f"{k} double" for k in FIT))


def fit_rounds(df: DataFrame, by: str, value: str) -> DataFrame:
    """(g, round, ll, m0, m1): how each group's fit went, a row per round from 1."""
    each = counted(df, by, value)
    kind = each.schema["g"].dataType.simpleString()

    def rounds(frame: pd.DataFrame) -> pd.DataFrame:
        frame, trace = frame.sort_values("v"), []
        v, n = frame["v"].to_numpy(), frame["n"].to_numpy().astype(float)
        if n.sum() >= 3 and v[0] < v[-1]:
            two_normals(v, n, trace)
        out = pd.DataFrame(trace, columns=["ll", "m0", "m1"]).astype(float)
        return out.assign(g=frame["g"].iloc[0], round=range(1, len(out) + 1))[["g", "round", "ll", "m0", "m1"]]

    return each.groupBy("g").applyInPandas(rounds, f"g {kind}, round int, ll double, m0 double, m1 double")


def mixture_calls(df: DataFrame, by: str, value: str) -> DataFrame:
    """A row per group: g, n_total, n_positive, percent_positive, threshold (infinite if there is no positive population), bimodal, delta_bic, ashman_d, note and the fit."""
    f = fits(df, by, value)
    has = F.col("m0").isNotNull() & ~F.isnan("m0")
    col = F.col
    f = f.withColumns({k: C.known(col(k)) for k in FIT})
    delta = F.when(has, C.bic(col("n"), col("ll1"), 1) - C.bic(col("n"), col("ll2"), 2)).otherwise(0.0)
    d = F.when(has, C.ashman_d(col("m0"), col("m1"), col("s0"), col("s1"))).otherwise(0.0)
    f = f.withColumns({"delta_bic": delta, "ashman_d": d}).withColumn("bimodal", has & (col("delta_bic") > C.EVIDENCE) & (col("ashman_d") > C.DISTANCE))
    f = f.withColumn("threshold", F.when(col("bimodal"), C.crossover(*(col(k) for k in ("w0", "w1", "m0", "m1", "s0", "s1")))).otherwise(F.lit(INF)))
    note = (
        F.when((col("n") < 3) | (col("hi") <= col("lo")), "too few or identical objects to fit a mixture")
        .when(col("bimodal"), F.format_string("two populations: negative mean %.1f, positive mean %.1f (evidence %.1f)", "m0", "m1", "delta_bic"))
        .when(col("delta_bic") <= C.EVIDENCE, F.format_string("no positive population: one component fits about as well (evidence %.1f)", "delta_bic"))
        .otherwise(F.format_string("no positive population: the two components overlap (distance %.1f)", "ashman_d"))
    )
    called = counted(df, by, value).join(f.select("g", "threshold"), "g").groupBy("g").agg(F.sum(F.when(col("v") >= col("threshold"), col("n")).otherwise(0)).alias("n_positive"))
    return f.join(called, "g").select("g", col("n").alias("n_total"), "n_positive", (100 * col("n_positive") / col("n")).alias("percent_positive"), "threshold", "bimodal", "delta_bic", "ashman_d", note.alias("note"), *FIT[:6])


def mixture_objects(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with threshold, bimodal, positive (by the threshold) and posterior (of the brighter component)."""
    return called_objects(df, by, value, mixture_calls(df, by, value))


def called_objects(df: DataFrame, by: str, value: str, calls: DataFrame) -> DataFrame:
    """df with threshold, bimodal, positive and posterior under fits of other objects; groups without a fit drop out."""
    calls = calls.withColumnRenamed("g", by)
    v = F.col(value).cast("double")
    up, down = (F.log(F.col(f"w{k}")) + C.normal_logpdf(v, F.col(f"m{k}"), F.col(f"s{k}")) for k in (1, 0))
    return df.join(calls.select(by, "threshold", "bimodal", "w0", "w1", "m0", "m1", "s0", "s1"), by).withColumns({"positive": v >= F.col("threshold"), "posterior": F.when(F.col("bimodal"), 1 / (1 + F.exp(down - up))).otherwise(0.0)}).drop("w0", "w1", "m0", "m1", "s0", "s1")


def control_call(df: DataFrame, by: str, value: str, control: DataFrame, percentile: float = 99.0) -> DataFrame:
    """Threshold at a percentile of the negative control's values (one row, so the join is broadcast); at or above is positive. An empty control is an error."""
    t = control.agg(F.percentile(value, F.lit(percentile / 100)).alias("threshold"))
    t = t.select(F.when(F.col("threshold").isNull(), F.raise_error(F.lit("the negative control has no objects"))).otherwise(F.col("threshold")).cast("double").alias("threshold"))
    return df.join(F.broadcast(t)).groupBy(by).agg(F.count("*").alias("n_total"), F.count_if(F.col(value) >= F.col("threshold")).alias("n_positive"), F.max("threshold").alias("threshold")).withColumn("percent_positive", C.ratio(100 * F.col("n_positive"), F.col("n_total")))


def manual_call(df: DataFrame, by: str, value: str, threshold) -> DataFrame:
    t = threshold if not isinstance(threshold, int | float) else F.lit(float(threshold))
    return df.groupBy(by).agg(F.count("*").alias("n_total"), F.count_if(F.col(value) >= t).alias("n_positive")).withColumn("percent_positive", C.ratio(100 * F.col("n_positive"), F.col("n_total")))


def report(calls: DataFrame, method: str, source: str = "image", control: str | None = None, context: dict | None = None) -> DataFrame:
    """(g, report): fixed-order lines that suffice to reproduce each call. context: further lines after the source, by name: columns of calls, or values."""
    line = lambda name, value: F.concat(F.rpad(F.lit(name), 24, " "), F.lit(": "), value)
    shown = lambda f, *c: F.format_string(f, *c)
    threshold = F.when(F.col("threshold") == INF, "inf").otherwise(shown("%.3f", "threshold"))
    # The report's lines, their names and formats.
    lines = [
        F.lit("MARKER POSITIVITY — REPRODUCIBILITY REPORT"), F.lit("=" * 44), line(source, F.col("g").cast("string")), *[line(k, F.coalesce((v if hasattr(v, "cast") else F.lit(v)).cast("string"), F.lit(""))) for k, v in (context or {}).items()], line("method", F.lit(method)), line("objects measured", F.col("n_total").cast("string")),
        line("marker-positive", F.col("n_positive").cast("string")), line("percent positive", shown("%.2f%%", "percent_positive")), line("threshold (0-255)", threshold), line("distinct populations", F.when(F.col("bimodal"), "yes").otherwise("no")),
        F.when(F.col("delta_bic").isNotNull(), line("bimodality ΔBIC", shown("%.2f", "delta_bic"))),
        F.when(F.col("m0").isNotNull(), line("negative component", shown("mean %.2f, sd %.2f, weight %.3f", "m0", "s0", "w0"))),
        F.when(F.col("m1").isNotNull(), line("positive component", shown("mean %.2f, sd %.2f, weight %.3f", "m1", "s1", "w1"))),
        line("negative control", F.lit(control)) if control else F.lit(None).cast("string"), F.concat(F.lit("note: "), F.col("note")),
    ]
    return calls.select("g", F.concat_ws("\n", *lines).alias("report"))


# ---- methods to compare with


def kmeans_threshold(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> float:
    """The middle of two centres that start at the extremes; the centres before the last, negligible move count."""
    if n.sum() < 3 or v[0] >= v[-1]:
        return INF
    at = np.array([v[0], v[-1]])
    for _ in range(rounds):
        high = np.abs(v - at[1]) < np.abs(v - at[0])
        new = np.array([np.average(v[m], weights=n[m]) if m.any() else c for m, c in ((~high, at[0]), (high, at[1]))])
        if np.allclose(new, at):
            break
        at = new
    return float(at.mean())


def gamma_threshold(v: np.ndarray, n: np.ndarray) -> float:
    """Two gamma components by expectation maximisation with moments, met on a grid of 512 points between their means: the last point before the first meeting."""
    from math import lgamma

    floor = 1e-6
    v = np.maximum(v, floor)
    if n.sum() < 3 or v[0] >= v[-1]:
        return INF
    low = v <= weighted_median(v, n)
    if low.all():
        return INF

    def moments(share):
        size = max(float((share * n).sum()), floor)
        mean = float((share * n * v).sum()) / size
        var = max(float((share * n * (v - mean) ** 2).sum()) / size, floor)
        return mean * mean / var, var / mean

    def logpdf(x, shape, scale):
        shape, scale = max(shape, floor), max(scale, floor)
        return (shape - 1) * np.log(x) - x / scale - shape * np.log(scale) - lgamma(shape)

    shapes = [moments(m.astype(float)) for m in (low, ~low)]
    weight = np.array([n[low].sum(), n[~low].sum()]) / n.sum()
    before = -INF
    for _ in range(ROUNDS):
        parts = np.stack([np.log(w) + logpdf(v, *s) for w, s in zip(weight, shapes, strict=True)])
        both = np.logaddexp(*parts)
        now, share = float((n * both).sum()), np.exp(parts - both)
        shapes = [moments(s) for s in share]
        weight = np.maximum((share * n).sum(axis=1), floor) / n.sum()
        if abs(now - before) < TOLERANCE * max(1.0, abs(before)):
            break
        before = now
    means = [a * b for a, b in shapes]
    first, second = np.argsort(means, kind="stable")
    if means[second] <= means[first]:
        return INF
    grid = np.linspace(means[first], means[second], 512)
    ahead = np.sign(np.log(weight[second]) + logpdf(grid, *shapes[second]) - np.log(weight[first]) - logpdf(grid, *shapes[first]))
    turns = np.flatnonzero(np.diff(ahead))
    return float(grid[turns[0]]) if len(turns) else float((means[first] + means[second]) / 2)


def thresholds_by(df: DataFrame, by: str, value: str, method) -> DataFrame:
    """(g, threshold) of method(values, counts) per group."""
    each = counted(df, by, value)
    kind = each.schema["g"].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        return pd.DataFrame({"g": frame["g"].iloc[:1], "threshold": [float(method(frame["v"].to_numpy(), frame["n"].to_numpy().astype(float)))]})

    return each.groupBy("g").applyInPandas(one, f"g {kind}, threshold double")


def positive_percent(df: DataFrame, by: str, value: str, thresholds: DataFrame) -> DataFrame:
    """(g, percent): share at or above each group's threshold, 0 where it is infinite."""
    return counted(df, by, value).join(thresholds, "g").groupBy("g").agg((100 * F.sum(F.when(F.col("v") >= F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("percent"))


def head_to_head(df: DataFrame, by: str, value: str, truth: DataFrame) -> DataFrame:
    """(method, mean_error, on_negative): mean absolute error in points over groups with positives, and the mean call on groups without. truth: (g, truth)."""
    from .markers import exact_otsu

    mixed = mixture_calls(df, by, value)
    ungated = mixed.withColumn("threshold", F.when(F.col("m0").isNotNull(), C.crossover(*(F.col(k) for k in ("w0", "w1", "m0", "m1", "s0", "s1")))).otherwise(F.lit(INF)))
    methods = {
        "gaussian_gated": mixed.select("g", "threshold"), "gaussian": ungated.select("g", "threshold"), "gamma": thresholds_by(df, by, value, gamma_threshold),
        "kmeans": thresholds_by(df, by, value, kmeans_threshold), "otsu": exact_otsu(df, by, value).withColumnRenamed(by, "g"),
    }
    out = None
    for name, t in methods.items():
        one = positive_percent(df, by, value, t).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    joined = out.join(truth, "g")
    return joined.groupBy("method").agg(F.avg(F.when(F.col("truth") > 0, F.abs(F.col("percent") - F.col("truth")))).alias("mean_error"), F.avg(F.when(F.col("truth") == 0, F.col("percent"))).alias("on_negative"))


def dose_response(objects: DataFrame, drug: str, well: str, dose: str, value: str, percentile: float = 99.0) -> DataFrame:
    """(drug, method, dose, percent, wells): mean percent positive per dose, by mixture per well, and anchored to the drug's own untreated wells (dose 0), which is missing for a drug without any."""
    d, w, z = F.col(drug), F.col(well), F.col(dose)
    wells = objects.groupBy(d.alias("drug"), w.alias("well"), z.alias("dose")).agg(F.count("*").alias("n"))
    mixed = mixture_calls(objects.withColumn("_well", F.struct(d.alias("d"), w.alias("w"))), "_well", value)
    mixed = mixed.select(F.col("g.d").alias("drug"), F.col("g.w").alias("well"), "percent_positive").join(wells, ["drug", "well"]).withColumn("method", F.lit("mixture"))
    control = objects.where(z == 0).groupBy(d.alias("drug")).agg(F.percentile(value, F.lit(percentile / 100)).alias("threshold"))
    anchored = objects.select(d.alias("drug"), w.alias("well"), z.alias("dose"), F.col(value).alias("v")).join(control, "drug")
    anchored = anchored.groupBy("drug", "well", "dose").agg((100 * F.count_if(F.col("v") >= F.col("threshold")) / F.count("*")).alias("percent_positive")).withColumn("method", F.lit("control"))
    both = mixed.select("drug", "method", "dose", "percent_positive").union(anchored.select("drug", "method", "dose", "percent_positive"))
    return both.groupBy("drug", "method", "dose").agg(F.avg("percent_positive").alias("percent"), F.count("*").alias("wells"))
