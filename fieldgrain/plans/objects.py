"""Queries over object tables: summaries, markers, histograms, text outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import markers, measure
from ..sources import writers
from .catalog import PX, patches, quadrant, quadrant_sql, query, table

R = lambda c, n=6: F.round(c, n).alias(c)


def _objects(spark, sf_dir):
    """lineitem as an object table: orders are images."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("object_id"), F.col("l_quantity").alias("area_pixels"), (F.col("l_extendedprice") / 1000).alias("mean_intensity"), C.circularity(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("circularity"), (F.col("l_discount") > 0.05).alias("touches_border"))


def _images(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderpriority") == "1-URGENT", "damaged file").alias("error"))


CIRC = "CASE WHEN l_extendedprice > 0 THEN greatest(0, least(1, 4 * pi() * l_quantity / ((l_extendedprice / 1000) * (l_extendedprice / 1000)))) END"
OBJ = f"obj AS (SELECT l_orderkey AS image, l_quantity AS area_pixels, l_extendedprice / 1000 AS mean_intensity, {CIRC} AS circularity, l_discount > 0.05 AS touches_border FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round({CIRC}, 6) AS circularity FROM lineitem")
def circularity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(C.circularity(F.col("l_quantity"), F.col("l_extendedprice") / 1000), 6).alias("circularity"))


@query(f"WITH {OBJ}, s AS (SELECT image, count(*) AS n, avg(area_pixels) AS a, median(area_pixels) AS m, avg(mean_intensity) AS i, avg(circularity) AS c, count(*) FILTER (touches_border) AS b FROM obj GROUP BY image) SELECT o_orderkey AS image, coalesce(n, 0) AS count, round(a, 6) AS mean_area, round(m, 6) AS median_area, round(i, 9) AS mean_intensity, round(c, 9) AS mean_circularity, coalesce(b, 0) AS border_count FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN s ON image = o_orderkey")
def measure_summary(spark, sf_dir):
    s = measure.summarize(_images(spark, sf_dir), _objects(spark, sf_dir))
    return s.select("image", "count", R("mean_area"), R("median_area"), R("mean_intensity", 9), R("mean_circularity", 9), "border_count")


BATCH = "batch AS (SELECT o_orderkey AS image, CASE WHEN o_orderpriority = '1-URGENT' THEN 'damaged file' END AS error, n, a FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query(f"WITH {BATCH} SELECT image, error, CASE WHEN error IS NULL THEN CAST(coalesce(n, 0) AS DOUBLE) END AS n_objects, CASE WHEN error IS NULL THEN round(a, 6) END AS mean_area FROM batch")
def batch_summary(spark, sf_dir):
    return measure.batch_summary(_images(spark, sf_dir), _objects(spark, sf_dir)).select("image", "error", F.col("n_objects").cast("double").alias("n_objects"), R("mean_area"))


@query(f"WITH {BATCH} SELECT count(*) AS images, count(error) AS failed, CAST(sum(CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS objects FROM batch")
def batch_union(spark, sf_dir):
    return measure.batch_total(measure.batch_summary(_images(spark, sf_dir), _objects(spark, sf_dir)))


# ---- two channels: quadrants are objects, the neighbour vector is the marker plane

TWO = f"two AS (SELECT a.image, a.y, a.x, {quadrant_sql('a.v', 0).replace('(y', '(a.y').replace('(x', '(a.x').replace('least(x', 'least(a.x')} AS label, b.v AS m FROM px a JOIN px b ON b.image = a.image + 1 AND b.y = a.y AND b.x = a.x)"
MEANS = f"{PX}, {TWO}, mk AS (SELECT image, CAST(label AS BIGINT) AS object_id, avg(m) * 255 AS marker_mean, max(m) * 255 AS marker_max FROM two WHERE label > 0 GROUP BY ALL)"
CALLED = f"{MEANS}, called AS (SELECT *, marker_mean >= 2.5 AS p FROM mk)"


def _marked(spark, sf_dir):
    px = patches(spark, sf_dir)
    marker = px.select((F.col("image") - 1).alias("image"), "y", "x", F.col("v").alias("m"))
    return px.withColumn("label", quadrant("v", 0)).join(marker, ["image", "y", "x"])


def _called(spark, sf_dir):
    means = markers.object_means(_marked(spark, sf_dir))
    return markers.call(means, means.select("image").distinct().withColumn("threshold", F.lit(2.5)), "image")


@query(f"WITH {MEANS} SELECT image, object_id, round(marker_mean, 6) AS marker_mean, round(marker_max, 6) AS marker_max FROM mk")
def marker_means(spark, sf_dir):
    return markers.object_means(_marked(spark, sf_dir)).select("image", "object_id", R("marker_mean"), R("marker_max"))


@query(f"WITH {MEANS}, lab AS (SELECT image, y, x, {quadrant_sql('v', 0)} AS label FROM px), o AS (SELECT image, CAST(label AS BIGINT) AS object_id, count(*) AS area FROM lab WHERE label > 0 GROUP BY ALL) SELECT o.image, o.object_id, CAST(area AS DOUBLE) AS area_pixels, round(marker_mean, 6) AS marker_mean FROM o LEFT JOIN mk USING (image, object_id)")
def marker_join(spark, sf_dir):
    o = measure.regions(patches(spark, sf_dir).withColumn("label", quadrant("v", 0))).select("image", "object_id", "area_pixels")
    return o.join(markers.object_means(_marked(spark, sf_dir)), ["image", "object_id"], "left").select("image", "object_id", "area_pixels", R("marker_mean"))


SEP = "CASE WHEN min(marker_mean) FILTER (p) IS NULL OR max(marker_mean) FILTER (NOT p) IS NULL THEN NULL WHEN max(marker_mean) <= min(marker_mean) THEN 0 ELSE greatest(0, (min(marker_mean) FILTER (p) - max(marker_mean) FILTER (NOT p)) / (max(marker_mean) - min(marker_mean))) END"


@query(f"WITH {CALLED} SELECT image, round({SEP}, 6) AS separation FROM called GROUP BY image")
def marker_separation(spark, sf_dir):
    c = _called(spark, sf_dir)
    return markers.summarize(c, c, "image").select("image", R("separation"))


@query(f"WITH {CALLED}, s AS (SELECT image, count(*) AS total, count(*) FILTER (p) AS positive, avg(marker_mean) FILTER (p) AS mp, avg(marker_mean) FILTER (NOT p) AS mn, {SEP} AS sep FROM called GROUP BY image) SELECT vec_id AS image, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive, coalesce(total - positive, 0) AS negative, round(100.0 * positive / total, 6) AS percent_positive, round(mp, 6) AS mean_positive_intensity, round(mn, 6) AS mean_negative_intensity, round(sep, 6) AS separation FROM embeddings LEFT JOIN s ON image = vec_id")
def marker_summary(spark, sf_dir):
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"))
    s = markers.summarize(images, _called(spark, sf_dir), "image")
    return s.select("image", "total", "positive", "negative", *map(R, ("percent_positive", "mean_positive_intensity", "mean_negative_intensity", "separation")))


BINS = "span AS (SELECT event_type, min(value) AS lo, max(value) AS hi, CAST(greatest({least}, least(40, floor(sqrt(count(*)) * {factor}))) AS INT) AS bins FROM events GROUP BY event_type), binned AS (SELECT e.event_type, lo, hi, bins, value, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * bins), bins - 1) ELSE 0 END AS INT) AS bin FROM events e JOIN span USING (event_type))"


@query(f"WITH {BINS.format(least=6, factor=1.5)} SELECT event_type, bin, round(lo + bin * ((hi - lo) / bins), 6) AS lower, count(*) AS n FROM binned GROUP BY ALL")
def area_histogram(spark, sf_dir):
    return measure.histogram(table(spark, sf_dir, "events"), "value", "event_type", 1.5, 6).select("event_type", "bin", R("lower"), "n")


@query(f"WITH {BINS.format(least=8, factor=2.0)} SELECT event_type, bin, round(lo + bin * ((hi - lo) / bins), 6) AS lower, count(*) AS n, count(*) FILTER (value >= 100) AS n_split FROM binned GROUP BY ALL")
def marker_histogram(spark, sf_dir):
    return measure.histogram(table(spark, sf_dir, "events"), "value", "event_type", 2.0, 8, split=F.col("value") >= 100).select("event_type", "bin", R("lower"), "n", "n_split")


@query("SELECT s_suppkey, s_nationkey, printf('%.3f', s_acctbal) AS s_acctbal FROM supplier")
def csv_three_decimals(spark, sf_dir):
    return writers.csv_ready(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))


@query("SELECT o_orderkey, n <= 100 AND d >= 12 AS show_ids, round(least(0.9, greatest(0.32, d / 30)), 6) AS font_scale FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, sqrt(4 * median(l_quantity) * 10 / pi()) AS d FROM lineitem GROUP BY l_orderkey)")
def id_visibility(spark, sf_dir):
    """Whether object numbers are drawn, and how large: few objects, large enough."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), C.equivalent_diameter(F.median("l_quantity") * 10).alias("d"))
    return g.select("o_orderkey", ((F.col("n") <= 100) & (F.col("d") >= 12)).alias("show_ids"), F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.32), F.col("d") / 30)), 6).alias("font_scale"))
