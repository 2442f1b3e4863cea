"""Queries that hold predicted objects against true ones, and searches over parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from .catalog import PX, patches, quadrant, quadrant_sql, query, table

R = lambda c, n=6: F.round(c, n).alias(c)


def _planes(spark, sf_dir):
    """Two label planes over the same patch: other cut-offs, and a seam moved by one pixel."""
    return patches(spark, sf_dir).withColumns({"pred": quadrant("v", 0), "truth": quadrant("v", 0.03, 1)})


TWO = f"{PX}, pl AS (SELECT image, y, x, {quadrant_sql('v', 0)} AS pred, {quadrant_sql('v', 0.03, 1)} AS tru FROM px), ov AS (SELECT image, pred, tru, count(*) AS n FROM pl WHERE pred > 0 AND tru > 0 GROUP BY ALL)"
PAIRS = f"{TWO}, pa AS (SELECT image, pred, count(*) AS p FROM pl WHERE pred > 0 GROUP BY ALL), ta AS (SELECT image, tru, count(*) AS t FROM pl WHERE tru > 0 GROUP BY ALL), iou AS (SELECT ov.*, p, t, CAST(n AS DOUBLE) / (p + t - n) AS iou FROM ov JOIN pa USING (image, pred) JOIN ta USING (image, tru))"
COUNTS = "cnt AS (SELECT image, count(DISTINCT pred) FILTER (pred > 0) AS n_pred, count(DISTINCT tru) FILTER (tru > 0) AS n_true FROM pl GROUP BY image)"
#: At most four objects a side: the best assignment is found among all of them, the first of equal ones by total alone.
SOLVED = f"""{PAIRS}, {COUNTS}, slot AS (SELECT CAST(unnest(range(5)) AS INT) AS t), perm AS (SELECT a.t AS t1, b.t AS t2, c.t AS t3, d.t AS t4 FROM slot a, slot b, slot c, slot d WHERE (a.t = 0 OR a.t NOT IN (b.t, c.t, d.t)) AND (b.t = 0 OR b.t NOT IN (c.t, d.t)) AND (c.t = 0 OR c.t <> d.t)),
wide AS (SELECT image, map_from_entries(list((pred * 10 + tru, iou))) AS m FROM iou GROUP BY image),
tried AS (SELECT image, t1, t2, t3, t4, m, coalesce(m[10 + t1], 0) AS i1, coalesce(m[20 + t2], 0) AS i2, coalesce(m[30 + t3], 0) AS i3, coalesce(m[40 + t4], 0) AS i4 FROM wide, perm),
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(i1 + i2 + i3 + i4, 9) DESC) = 1),
ma AS (SELECT image, unnest([i1, i2, i3, i4]) AS iou FROM best),
pct AS (SELECT CAST(unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) AS INT) AS percent),
sc AS (SELECT cnt.image, percent, n_pred, n_true, (SELECT count(*) FROM ma WHERE ma.image = cnt.image AND ma.iou >= percent / 100.0::DOUBLE) AS tp FROM cnt, pct)"""


@query(f"WITH {TWO} SELECT image, pred, tru AS true_label, n FROM ov")
def overlap_matrix(spark, sf_dir):
    return scoring.overlaps(_planes(spark, sf_dir)).withColumnRenamed("truth", "true_label")


@query(f"WITH {PAIRS} SELECT image, pred, tru AS true_label, round(iou, 6) AS iou FROM iou")
def iou_pairs(spark, sf_dir):
    return scoring.ious(_planes(spark, sf_dir)).select("image", "pred", F.col("truth").alias("true_label"), R("iou"))


@query(f"WITH {PAIRS}, cl AS (SELECT * FROM iou WHERE n >= 0.25 * t), s AS (SELECT image, count(*) AS k FROM (SELECT image, tru FROM cl GROUP BY ALL HAVING count(*) >= 2) GROUP BY image), g AS (SELECT image, count(*) AS k FROM (SELECT image, pred FROM cl GROUP BY ALL HAVING count(*) >= 2) GROUP BY image) SELECT vec_id AS image, coalesce(s.k, 0) AS split, coalesce(g.k, 0) AS merge FROM embeddings LEFT JOIN s ON s.image = vec_id LEFT JOIN g ON g.image = vec_id")
def split_merge(spark, sf_dir):
    px = _planes(spark, sf_dir)
    return scoring.split_merge(scoring.ious(px), scoring.object_counts(px))


@query(f"WITH {SOLVED} SELECT image, percent, tp, n_pred - tp AS fp, n_true - tp AS fn FROM sc")
def score_by_threshold(spark, sf_dir):
    px = _planes(spark, sf_dir)
    return scoring.by_threshold(scoring.matched(scoring.ious(px)), scoring.object_counts(px))


@query(f"WITH {TWO}, {COUNTS} SELECT image, n_pred - n_true AS count_error FROM cnt")
def count_error(spark, sf_dir):
    """Objects too many (positive) or too few (negative) per image."""
    return scoring.count_errors(scoring.object_counts(_planes(spark, sf_dir))).select("image", "count_error")


@query(f"""WITH {SOLVED}, t AS (SELECT percent, sum(tp) AS tp, sum(n_pred - tp) AS fp, sum(n_true - tp) AS fn FROM sc GROUP BY percent)
SELECT (SELECT count(*) FROM cnt) AS images, (SELECT CAST(sum(n_pred) AS BIGINT) FROM cnt) AS predicted, (SELECT CAST(sum(n_true) AS BIGINT) FROM cnt) AS true_objects, (SELECT round(avg(abs(n_pred - n_true) / n_true) FILTER (n_true > 0), 6) FROM cnt) AS count_mape,
round(max(2.0 * tp / (2 * tp + fp + fn)) FILTER (percent = 50), 6) AS f1_50, round(max(CAST(tp AS DOUBLE) / (tp + fp)) FILTER (percent = 50), 6) AS precision_50, round(max(CAST(tp AS DOUBLE) / (tp + fn)) FILTER (percent = 50), 6) AS recall_50, round(max(2.0 * tp / (2 * tp + fp + fn)) FILTER (percent = 75), 6) AS f1_75, round(avg(CAST(tp AS DOUBLE) / (tp + fp + fn)), 6) AS average_precision, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS mean_f1,
(SELECT round(avg(iou), 6) FROM ma WHERE iou > 0) AS mean_matched_iou, (SELECT CAST(sum(n_pred - n_true) AS BIGINT) FROM cnt) AS count_error,
(SELECT count(*) FROM (SELECT image, tru FROM iou WHERE n >= 0.25 * t GROUP BY ALL HAVING count(*) >= 2)) AS split_errors, (SELECT count(*) FROM (SELECT image, pred FROM iou WHERE n >= 0.25 * t GROUP BY ALL HAVING count(*) >= 2)) AS merge_errors FROM t""")
def dataset_score(spark, sf_dir):
    px = _planes(spark, sf_dir)
    pairs, counts = scoring.ious(px), scoring.object_counts(px)
    return scoring.dataset(scoring.matched(pairs), scoring.split_merge(pairs, counts), counts).select("images", "predicted", "true_objects", "count_error", "split_errors", "merge_errors", *map(R, ("count_mape", "f1_50", "precision_50", "recall_50", "f1_75", "average_precision", "mean_f1", "mean_matched_iou")))


@query("""WITH g AS (SELECT a.i AS low, b.i AS high FROM (SELECT CAST(unnest(range(4)) AS INT) AS i) a, (SELECT CAST(unnest(range(4)) AS INT) AS i) b), s AS (SELECT low, high, low * 4 + high AS place, avg(abs(n - 12)) AS score FROM (SELECT low, high, vec_id, (SELECT count(*) FROM (SELECT unnest(embedding) AS v) WHERE v > 0.05 * low AND v <= 0.2 + 0.05 * high) AS n FROM embeddings, g) GROUP BY ALL)
SELECT low, high, round(score, 6) AS score FROM s ORDER BY s.score, place LIMIT 5""")
def grid_search_topk(spark, sf_dir):
    """The five of sixteen parameter pairs whose counts are nearest to the wanted one; of equal ones the first in the grid."""
    n = range(4)
    grid = spark.createDataFrame([(a, b, a * 4 + b) for a in n for b in n], "low int, high int, place int")
    px = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    # Sixteen rows: each image is read once, and tried with all of them.
    tried = px.crossJoin(F.broadcast(grid)).select("low", "high", "place", F.size(F.filter("e", lambda v: (v > 0.05 * F.col("low")) & (v <= 0.2 + 0.05 * F.col("high")))).alias("n"))
    s = tried.groupBy("low", "high", "place").agg(F.avg(F.abs(F.col("n") - 12)).alias("score"))
    return s.orderBy("score", "place").limit(5).select("low", "high", R("score"))


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS shared")
def split_leakage(spark, sf_dir):
    """Images that are in two splits at once."""
    li = table(spark, sf_dir, "lineitem")
    part = lambda f: li.where(F.col("l_returnflag") == f).select("l_orderkey")
    return part("R").intersect(part("A")).agg(F.count("*").alias("shared"))


@query("SELECT DISTINCT label AS dose FROM embeddings")
def distinct_doses(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("dose")).distinct()
