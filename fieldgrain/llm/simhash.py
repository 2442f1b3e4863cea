"""Near-duplicates by SimHash with a segment-popcount grid (operator 1).

A 64-bit fingerprint is cut into 32 segments of 2 bits, and mapped to its 32 bit counts. The Manhattan distance of two
count vectors never exceeds the Hamming distance of the fingerprints. For distance d the segments are dealt to d + k
blocks, k = 4: two vectors within d agree in all counts of at least k blocks, so a range join of that radius is an
equi-join over the C(d + k, k) grids spanned by k blocks each. It is exact: every pair within d meets in some cell.

Only distinct fingerprints enter the grid, so exact copies cost one row. In a crowded cell not all pairs are made:
first each fingerprint is tried against the cell's least one, and the components of those links are taken; afterwards
only pairs from different components are tried, and none at all where a cell holds one component only. This finds the
same components as all pairs would. Joins of such tables are dealt out by key. Candidates pass the Manhattan bound, then the exact Hamming distance.

null text: as the empty text. No words: fingerprint zero, linked like any other. Fewer words than a shingle has: the
whole sequence is one shingle. A null doc_id stays a row; it belongs to its fingerprint's component, and the component
id is the smallest non-null id. Empty table: no rows. Repeated rows stay, each with the same component. Ties: a bit that
is set in exactly half the shingles is 0. Texts of any length are read whole. Further columns stay out of the result.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import shingle_links
from .common import cut, dealt, drop, few_files, join_hot, table
from .components import components
from .shingles import fingerprint_of


def fingerprint(text: Column, words: int = 4) -> Column:
    @pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return fingerprints(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grids(distance: int, equal: int = 4) -> list[int]:
    """For each set of `equal` blocks the mask of their bits. More of them make cells rarer met by chance, and rows more."""
    blocks = distance + equal
    bits = [sum(3 << 2 * s for s in range(32) if s * blocks // 32 == b) for b in range(blocks)]
    return [_signed(sum(c)) for c in combinations(bits, equal)]


def counts_in_unary(fp: Column) -> Column:
    """The 32 bit counts, 0 as 00, 1 as 01, 2 as 11, so that differing bits are their Manhattan distance."""
    odd = F.lit(0x5555555555555555)
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(odd), fp.bitwiseAND(odd)
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link(prints: DataFrame, distance: int = 4) -> DataFrame:
    """From distinct fingerprints (fp) those that have a link: (fp, root), root being the same for all that are connected."""
    # Every row becomes one row a grid: deal the few rows out to all cores first.
    spread = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = spread.select("fp", counts_in_unary(F.col("fp")).alias("u")).select(
        "fp", "u", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("grid"), F.col("u").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grids(distance))])).alias("at")
    ).select("fp", "u", "at.grid", "at.cell")
    crowded = cells.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    # In a cell of two the least one is tried against the only other: such a row is needed no more unless they link.
    c, w = cells.alias("c"), crowded.alias("w")
    linked = (F.col("fp") != F.col("least")) & (_apart("fp", "least") <= distance)
    rows = cut(c.join(dealt(w), (F.col("c.grid") == F.col("w.grid")) & (F.col("c.cell") == F.col("w.cell")) & ((F.col("n") > 2) | linked)).select("fp", "u", "c.grid", "c.cell", "n", "least"), "cells")
    first = components(rows.where(linked).select(F.col("fp").alias("a"), F.col("least").alias("b")), of=rows)
    owned = rows.where("n > 2").drop("least", "n").join(dealt(first.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    groups = owned.groupBy("grid", "cell", "component").agg(F.count("*").alias("n")).groupBy("grid", "cell").agg(F.count("*").alias("groups"), F.max_by("component", "n").alias("main")).where("groups > 1")
    mixed = cut(few_files(owned.join(dealt(groups.drop("groups")), ["grid", "cell"]), rows), "mixed")
    x = mixed.where("component <> main").select("grid", "cell", F.col("fp").alias("xf"), F.col("u").alias("xu"), F.col("component").alias("a"))
    y = mixed.select("grid", "cell", F.col("fp").alias("yf"), F.col("u").alias("yu"), F.col("component").alias("b"), (F.col("component") == F.col("main")).alias("of_main"))
    pairs = x.join(dealt(y), (x.grid == y.grid) & (x.cell == y.cell) & (x.a != y.b) & (y.of_main | (x.xf < y.yf)) & (_apart("xu", "yu") <= distance) & (_apart("xf", "yf") <= distance))
    second = components(pairs.select("a", "b"))
    drop(rows, mixed)
    # Every fingerprint of either round, with the root of its root.
    alone = second.select(F.col("node").alias("fp"), F.col("node").alias("root")).join(dealt(first.select(F.col("node").alias("fp"))), "fp", "left_anti")
    out = cut(few_files(first.select(F.col("node").alias("fp"), F.col("component").alias("root")).union(alone).join(dealt(second.withColumnRenamed("node", "root")), "root", "left").select("fp", F.coalesce("component", "root").alias("root")), prints), "roots")
    drop(first, second)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, similarity: float | None = None, sample: int = 10_000) -> DataFrame:
    """A row per document: key, fp (signed), fingerprint (16 hex digits), component_id (the least key reachable), kept (it stands for its
    class: it has that key and, of texts under it, the least fingerprint; repeated rows alike).

    With a similarity also documents link whose sets of shingles are that similar (shingle_links), however far apart their
    fingerprints are; one document stands there for all that the fingerprints have linked. sample: documents that rank shingles.
    """
    if similarity is None:
        own = cut(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), words).alias("fp")), "prints")
    else:
        order = shingle_links.sampled_order(docs, key, text, words, sample)
        own = cut(shingle_links.described(docs, key, text, words, similarity, order), "prints")
    prints = cut(few_files(own.groupBy("fp").agg(F.min("key").alias("least")), own), "distinct")
    roots = link(prints, distance)
    classes = cut(few_files(prints.join(dealt(roots), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), prints, 2), "classes")
    drop(prints, roots)
    if similarity is not None:
        first = cut(few_files(_first(classes.where("least is not null")), classes), "first")
        rows = own.join(dealt(first.select("key", "fp")), ["key", "fp"], "left_semi").groupBy("key", "fp").agg(F.min("row").alias("row")).select("row")
        wide = shingle_links.link(own, rows, docs, key, text, words, similarity, order)
        joined = first.join(dealt(wide.withColumnRenamed("node", "fp")), "fp").select("root", "component")
        wider = cut(few_files(classes.join(dealt(joined), "root", "left").select("fp", "least", F.coalesce("component", "root").alias("root")), classes), "classes")
        drop(classes, first, wide)
        classes = wider
    first = _first(classes).select("root", F.col("key").alias("component_id"), F.col("fp").alias("first"))
    by_print = cut(few_files(join_hot(classes, first, "root").select("fp", "component_id", (F.col("fp") == F.col("first")).alias("first")), classes), "by-print")
    drop(classes)
    kept = F.coalesce(F.col("first") & (F.col("key") == F.col("component_id")), F.lit(False))
    return join_hot(own.select("key", "fp"), by_print, "fp").select(F.col("key").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"))


def _first(classes: DataFrame) -> DataFrame:
    """(root, key, fp): of each class the least key, and of its fingerprints the least; a class without keys has none."""
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp")))
    return classes.groupBy("root").agg(first.alias("first")).select("root", F.col("first.least").alias("key"), F.col("first.fp").alias("fp"))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
