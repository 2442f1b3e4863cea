"""Whole analyses: two-channel images, and plates by dose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positivity, scoring, segment
from ..sources import synthetic
from .catalog import query, table
from .populations import em_sql

R = lambda c, n=6: F.round(c, n).alias(c)


def _truth_sql(names, columns: str) -> str:
    """What was drawn, and so what has to be found."""
    rows = [(f"{n}.png", synthetic.FIELDS[n].objects, synthetic.FIELDS[n].positive) for n in names]
    return f"SELECT {columns} FROM (VALUES " + ", ".join(f"('{p}', {n}, {k})" for p, n, k in rows) + ") AS t(path, n, k)"


STUDY = ("marker_none", "marker_10", "marker_30", "marker_50", "marker_70")


@query(_truth_sql(("marker_pair", "marker_none"), "path, CAST(NULL AS VARCHAR) AS error, n AS drawn, n AS n_objects, k AS drawn_positive, k AS n_positive, k > 0 AS bimodal, round(100.0 * k / n, 4) AS percent_positive"))
def two_channel_percent_positive(spark, sf_dir):
    """Generated two-channel images from PNG bytes to calls, beside what was drawn."""
    rows = synthetic.rows(("marker_pair", "marker_none"))
    files = spark.createDataFrame([(p, bytearray(c), n, k) for p, c, n, k in rows], "path string, content binary, drawn int, drawn_positive int")
    got = segment.percent_positive(files).join(files.drop("content"), "path")
    return got.select("path", "error", "drawn", "n_objects", "drawn_positive", "n_positive", "bimodal", R("percent_positive", 4))


def _plate(spark, sf_dir):
    """Vectors as wells, labels as doses of two drugs, components as objects."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("drug"), F.col("vec_id").alias("well"), (F.expr("label div 2")).cast("double").alias("dose"), F.explode("embedding").alias("v"))
    return e.withColumn("v", 100 + 100 * F.col("v").cast("double"))


PLATE = """plate AS (SELECT label % 2 AS drug, vec_id AS well, CAST(label // 2 AS DOUBLE) AS dose, 100 + 100 * CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
ctl AS (SELECT drug, quantile_cont(v, 0.99) AS t FROM plate WHERE dose = 0 GROUP BY drug), w AS (SELECT drug, well, dose, 100.0 * count(*) FILTER (v >= t) / count(*) AS p FROM plate JOIN ctl USING (drug) GROUP BY ALL),
d AS (SELECT drug, dose, avg(p) AS percent, count(*) AS wells FROM w GROUP BY ALL)"""


@query(f"WITH {PLATE} SELECT drug, dose, round(percent, 6) AS percent, wells FROM d")
def plate_dose_response(spark, sf_dir):
    got = positivity.dose_response(_plate(spark, sf_dir), "drug", "well", "dose", "v")
    return got.where("method = 'control'").select("drug", "dose", R("percent"), "wells")


@query(f"WITH {PLATE}, r AS (SELECT drug, row_number() OVER (PARTITION BY drug ORDER BY dose, q) AS rx, row_number() OVER (PARTITION BY drug ORDER BY q, dose) AS ry FROM (SELECT drug, dose, round(percent, 9) AS q FROM d)) SELECT drug, round(corr(rx, ry), 6) AS rho FROM r GROUP BY drug")
def plate_spearman(spark, sf_dir):
    got = positivity.dose_response(_plate(spark, sf_dir), "drug", "well", "dose", "v").where("method = 'control'")
    return scoring.spearman(got.withColumn("percent", F.round("percent", 9)), "drug", "dose", "percent").select("drug", R("rho"))


@query(f"WITH RECURSIVE {PLATE}, {em_sql('pop AS (SELECT well AS grp, v AS value FROM plate)')}, q AS (SELECT drug, dose, g, 100.0 * count(*) FILTER (v >= coalesce(threshold, 'inf'::DOUBLE)) / count(*) AS p FROM plate JOIN calls ON g = well GROUP BY ALL) SELECT drug, dose, round(avg(p), 6) AS percent, count(*) AS wells FROM q GROUP BY drug, dose")
def plate_mixture(spark, sf_dir):
    got = positivity.dose_response(_plate(spark, sf_dir), "drug", "well", "dose", "v").where("method = 'mixture'")
    return got.select("drug", "dose", R("percent"), "wells")


def _drawn(spark, names):
    return spark.createDataFrame([(p, bytearray(c), n, k) for p, c, n, k in synthetic.rows(names)], "path string, content binary, drawn int, drawn_positive int").repartition(spark.sparkContext.defaultParallelism, "path")


def _held(spark, names, params):
    """Drawn fields from PNG bytes through segmentation, against their coloured masks."""
    masks = spark.createDataFrame([(p, bytearray(m)) for p, m in synthetic.masks(names)], "path string, mask binary")
    return scoring.held_against(segment.analyze(_drawn(spark, names), params, planes=True), masks)


@query(_truth_sql(("easy", "moderate", "marker_pair"), "CAST(count(*) AS BIGINT) AS images, CAST(sum(n) AS BIGINT) AS predicted, CAST(sum(n) AS BIGINT) AS true_objects, 0 AS count_error, 0 AS split_errors, 0 AS merge_errors, 1.0 AS f1_50"))
def segmented_score(spark, sf_dir):
    """Image and coloured mask to scores: 512 x 512 fields, touching objects among them, have all their objects found."""
    return scoring.score_sets(_held(spark, ("easy", "moderate", "marker_pair"), segment.SegmentParams(channel="blue"))).select("images", "predicted", "true_objects", "count_error", "split_errors", "merge_errors", R("f1_50"))


@query()
def grid_search_f1(spark, sf_dir):
    """Parameter sets by F1 on drawn fields, the best first, each image decoded once: all sets in one job."""
    grid = segment.grid(channel=["blue"], watershed=[True, False], seed_depth=[0.5, 1.0, 2.0], smoothing_sigma=[0.6, 1.5])
    found = scoring.score_sets(_held(spark, ("moderate", "difficult"), grid))
    return found.orderBy(F.desc(F.round("mean_f1", 6)), "params").limit(5).select("params", R("f1_50"), R("mean_f1"), "count_error", "split_errors", "merge_errors")


ABLATIONS = {"as it is": {}, "no watershed": {"watershed": False}, "peaks": {"seeding": "peaks"}, "adaptive seeds": {"seeding": "adaptive"}, "refined borders": {"refine_band": 2}, "no smoothing": {"smoothing_sigma": 0.0}, "no stretch": {"normalize": False}}


@query()
def ablation(spark, sf_dir):
    """Each step left out or replaced: what it does to F1 and counts on touching and on difficult fields."""
    found = scoring.score_sets(_held(spark, ("moderate", "difficult"), {n: segment.SegmentParams(channel="blue", **p) for n, p in ABLATIONS.items()}))
    return found.select(F.col("params").alias("variant"), "images", R("f1_50"), R("mean_f1"), "count_error", "split_errors", "merge_errors")


@query(_truth_sql(("easy", "moderate"), "path, CAST(10 AS BIGINT) AS runs, CAST(1 AS BIGINT) AS thresholds, CAST(1 AS BIGINT) AS masks, CAST(n AS BIGINT) AS objects"))
def determinism(spark, sf_dir):
    """Ten analyses of each image: one threshold, one label plane, the drawn count."""
    found = segment.analyze(_drawn(spark, ("easy", "moderate")), {f"run {n}": segment.SegmentParams(channel="blue") for n in range(10)}, planes=True)
    return found.groupBy("path").agg(F.count("*").alias("runs"), F.count_distinct("threshold").alias("thresholds"), F.count_distinct(F.sha2("label_plane", 256)).alias("masks"), F.max("n_objects").alias("objects"))


@query()
def count_error_grid(spark, sf_dir):
    """Parameter sets by mean relative count error on drawn images, the best first: all sets in one job, each image decoded once."""
    files = _drawn(spark, ("easy", "moderate"))
    grid = segment.grid(channel=["blue"], seed_depth=[0.5, 1.0, 2.0], min_size=[40, 60])
    found = segment.analyze(files, grid).join(files.drop("content"), "path")
    errors = found.groupBy("params").agg(F.round(F.avg(F.abs(F.col("n_objects") - F.col("drawn")) / F.col("drawn")), 6).alias("count_error"), F.sum("n_objects").alias("objects"))
    return errors.orderBy("count_error", "params").limit(5)


@query(_truth_sql(STUDY, "path, round(100.0 * k / n, 4) AS truth, round(100.0 * k / n, 4) AS percent_positive, 0.0 AS error_points, k > 0 AS bimodal"))
def positivity_study(spark, sf_dir):
    """Error in points of the called percentage on drawn two-channel images with none to seventy percent positive."""
    files = _drawn(spark, STUDY)
    got = segment.percent_positive(files).join(files.drop("content"), "path")
    truth = 100 * F.col("drawn_positive") / F.col("drawn")
    return got.select("path", F.round(truth, 4).alias("truth"), R("percent_positive", 4), F.round(F.abs(F.col("percent_positive") - truth), 4).alias("error_points"), "bimodal")


@query("WITH s AS (SELECT event_type, k, count(*) FILTER (value >= 25 * k) AS n FROM events, (SELECT CAST(unnest(range(1, 9)) AS INT) AS k) GROUP BY ALL) SELECT event_type, k AS variant FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(n - 100), k) = 1")
def best_variant(spark, sf_dir):
    """Of eight cut-offs the one that calls nearest to a hundred objects; of equal ones the first."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") >= 25 * k).alias(f"n{k}") for k in range(1, 9)])
    tried = F.array(*[F.struct(F.abs(F.col(f"n{k}") - 100).alias("off"), F.lit(k).alias("variant")) for k in range(1, 9)])
    return e.select("event_type", F.array_min(tried)["variant"].alias("variant"))
