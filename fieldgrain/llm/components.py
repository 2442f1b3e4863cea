"""Connected components of an edge table of any size, by alternating large-star and small-star steps.

Each step is a minimum per node, which is pre-aggregated before its shuffle, and an equi-join, whose hot keys AQE may
split; no node's neighbours are ever gathered in one task. Edges stay on the executors, and every round is written to
the shared folder. Rounds grow with the logarithm of the longest path, and end as soon as all that is left are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, drop, few_files


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other node at most, and none that is pointed to points on."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", of: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node with an edge to another node: the smallest node reachable; a written table. Nulls and loops are ignored, repeats allowed. Empty edges give no rows. of: see few_files()."""
    now = cut(few_files(edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), of), "edges")
    while not _settled(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(few_files(large, now), "large")
        drop(now)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(dealt(least), "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).distinct()
        now = cut(few_files(small, large, 2), "small")
        drop(large)
    out = cut(few_files(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct()), now, 2), "components")
    drop(now)
    return out
