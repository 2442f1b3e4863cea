"""Where queries register, and the stand-in relations they bind to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame by its name, with the SQL that has to give the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark, sf_dir) -> DataFrame:
    """embeddings as 8 x 8 images: a row per pixel, with the label as stack."""
    return planes.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, "label")


def quadrant(value: str, cut: float, shift: int = 0):
    """A label plane: 1 to 4 by quadrant where value > cut; shift moves the vertical seam."""
    return F.when(F.col(value) > cut, F.expr(f"(y div 4) * 2 + (least(x + {shift}, 7) div 4) + 1")).otherwise(0).cast("int")


def population(spark, sf_dir) -> DataFrame:
    """(grp, value): a known share of bright objects per line status, and one skewed population per event type."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("line-"), "l_linestatus").alias("grp"), (20 + 100 * F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 80 + F.col("l_quantity") / 5).otherwise(0.0)).alias("value"))
    return li.union(table(spark, sf_dir, "events").select(F.concat(F.lit("event-"), "event_type"), "value"))


#: The same relations in SQL.
PX = "px AS (SELECT vec_id AS image, label, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
POP = "pop AS (SELECT 'line-' || l_linestatus AS grp, 20 + 100 * l_discount + CASE WHEN l_returnflag = 'R' THEN 80 + l_quantity / 5 ELSE 0 END AS value FROM lineitem UNION ALL SELECT 'event-' || event_type, value FROM events)"


def quadrant_sql(value: str, cut: float, shift: int = 0) -> str:
    return f"CASE WHEN {value} > {cut} THEN (y // 4) * 2 + (least(x + {shift}, 7) // 4) + 1 ELSE 0 END"
