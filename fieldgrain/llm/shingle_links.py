"""Links by the Jaccard similarity of word shingles, decided exactly: the wide part of operator 1 (see simhash.near_duplicates).

Fingerprints of documents with a similarity of 0.8 are some ten bits apart, too far for grids over them. So what the
fingerprints leave apart meets by prefix filtering: shingles are put in one order for all documents. Two sets of the
wanted similarity share a shingle among the first n - ceil(similarity x n) + 1 of either, so an equi-join of these
prefixes meets every pair that links, whatever the order. The order keeps shingles that many documents hold out of the
prefixes: those that a bounded sample holds often come last, and before them the crowded ones. These are marked in a
Bloom filter (CROWDED bits, whatever the size of the corpus) from counts over all prefixes, and prefixes that held
crowded shingles are made anew, twice, each shuffled once for it. What the filter takes for crowded by chance changes the order, not the links. So passages that unlike documents share make no pairs, unless a
document holds little else. A pair that is tried passes a bound first: shingles are dealt to
as many classes as the set has shingles (the next power of two), and the parities of their counts differ in no more
classes than the sets differ in shingles. What passes is decided on the whole sets, read again from the texts, so links
are neither missed nor made up (64-bit hashes stand for shingles).

A cell is a shingle with the documents whose prefix holds it. Cells of shingles that the sample holds often may be of any
size: their counts and centres are aggregated before their shuffle, and are few enough to be broadcast (bound: MOST).
In a crowded cell not all pairs are made: each member is tried against two members, others in each cell, which are all
pairs in cells of up to three, and the components of those links are taken. In larger cells of several components each
member is then tried against hubs, the members that have most links: edited copies of a text are often too far from each
other, but not from the text. Afterwards only pairs from different components are made, none where a cell holds one
component only, and only where the sketches allow the link and the cell comes so early in both prefixes that what follows
can make up the similarity: the first shingle that a pair shares does if it links. This finds the same components as all
pairs would. Unlike documents that share a cell are still compared by their sketches, pair by pair.

null text: as the empty text. Fewer words than a shingle has: the whole sequence is one shingle. Rows with a null id link
by their fingerprints only. Repeated rows are one node. Empty table: no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, dealt, drop, few_files, may_hold, release, some_ids, thrifty, without
from .components import components
from .shingles import digests, print_of

#: Classes of a sketch at least. Bits of the filter of crowded shingles, and the documents that crowd one. Shingles that the sample ranks.
SKETCH, CROWDED, CROWD, MOST = 256, 1 << 24, 8, 100_000
#: Rounds at most in which members of crowded cells are tried against hubs of their cells.
HUB_ROUNDS = 2
#: The filter's bits of a shingle are the numbers from these places on.
PLACES = (0, 20, 40)


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles from their digests."""
    return np.unique(hashes.reshape(-1).view(np.int64))


@dataclass
class Order:
    """The order of shingles: by their count in the sample (common: sorted hashes, often: their counts), then whether they are crowded, then by hash."""

    common: np.ndarray
    often: np.ndarray
    crowded: np.ndarray  # the filter, eight bits a number

    def is_crowded(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles), np.uint8)
        for place in PLACES:
            bit = (shingles.view(np.uint64) >> np.uint64(place)) & np.uint64(CROWDED - 1)
            out &= self.crowded[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)
        return out & 1

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """Sorted shingles in this order, and how many of them the sample does not rank."""
        rank = self.is_crowded(shingles).astype(np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
            rank = np.where(self.common[at] == shingles, self.often[at] + 1, rank)
        return shingles[np.argsort(rank, kind="stable")], int((rank < 2).sum())

    def prefix(self, shingles: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
        order, rare = self.of(shingles)
        size = prefix_size(len(shingles), similarity)
        return order[:size], min(rare, size)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parities of the classes, 64 a number. Half as many classes are the two halves' difference."""
    classes = max(SKETCH, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else SKETCH
    return np.packbits((np.bincount(shingles & (classes - 1), minlength=classes) & 1).astype(bool)).view(np.int64)


def apart(a: Column, b: Column) -> Column:
    """In how many classes two sketches differ; of sizes neither equal nor double 0."""
    half = lambda k: F.zip_with(F.slice(k, 1, F.size(k) / 2), F.slice(k, F.size(k) / 2 + 1, F.size(k) / 2), lambda x, y: x.bitwiseXOR(y))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, v: n + v)
    return F.when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) == 2 * F.size(b), differ(half(a), b)).when(2 * F.size(a) == F.size(b), differ(a, half(b))).otherwise(0)


def _near_enough(a: Column, na: Column, b: Column, nb: Column, similarity: float) -> Column:
    """Whether the sketches of sets of these sizes allow that similarity."""
    return apart(a, b) * (1 + similarity) <= (na + nb) * F.lit(1 - similarity) + 1e-6


def prefix_size(n: int, similarity: float) -> int:
    return n - int(np.ceil(n * similarity - 1e-9)) + 1 if n else 0


def sampled_order(docs: DataFrame, key: str, text: str, words: int, sample: int) -> Order:
    """Ranks the shingles that at least three documents of a bounded sample hold, at most MOST, the most frequent ones."""
    ids = F.broadcast(some_ids(docs.select(F.col(key).alias("id")), sample, "id").distinct())

    def each(batches):
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"s": shingles_of(digests(t, words))})

    some = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id").select("text").mapInPandas(thrifty(each), "s long")
    found = some.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(MOST).toPandas().sort_values("s")
    return Order(found["s"].to_numpy(np.int64), found["count"].to_numpy(np.int64), np.zeros(CROWDED // 8, np.uint8))


def described(docs: DataFrame, key: str, text: str, words: int, similarity: float, order: Order) -> DataFrame:
    """(row, key, fp, n, sketch, prefix, rare): a row per document, from one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                few, rows = b.iloc[at : at + 512], []
                for t in few["text"]:
                    hashes = digests(t, words)
                    found = shingles_of(hashes)
                    rows.append((print_of(hashes), len(found), sketch_of(found), *order.prefix(found, similarity)))
                yield pd.DataFrame(rows, columns=["fp", "n", "sketch", "prefix", "rare"]).assign(key=few["key"].to_numpy())

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(thrifty(each), f"fp long, n int, sketch array<long>, prefix array<long>, rare int, key {kind}").withColumn("row", F.monotonically_increasing_id())


def uncrowded(base: DataFrame, docs: DataFrame, key: str, text: str, words: int, similarity: float, order: Order, rounds: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """base (fp, key, n, prefix, rare) with prefixes that avoid crowded shingles where the documents have others; and the tables that it reads."""
    crowded, moved, tables = order.crowded.copy(), None, []
    for _ in range(rounds):
        counts = (base if moved is None else moved).select(F.explode("prefix").alias("cell")).groupBy("cell").count().where(F.col("count") >= CROWD)
        bits = F.explode(F.array(*[F.shiftrightunsigned("cell", place).bitwiseAND(F.lit(CROWDED - 1)) for place in PLACES])).alias("at")
        marked = counts.select(bits).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        words_of = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # CROWDED / 64 rows at most
        found = np.zeros(CROWDED // 64, np.int64)
        found[words_of["word"].to_numpy(np.int64)] = words_of["bits"].to_numpy(np.int64)
        found = found.view(np.uint8)
        if not (found & ~crowded).any():
            break
        crowded |= found
        drop(*tables)
        now = Order(order.common, order.often, crowded.copy())
        hit = _holds_crowded(now)
        affected = cut(base.where(hit("prefix")).select("fp", "key"), "affected")
        anew = described(may_hold(docs.select(key, text), affected.withColumnRenamed("key", key), key), key, text, words, similarity, now)
        # The texts stay where they are; other texts of an id have another print.
        moved = cut(_of(anew.select("fp", "key", "n", "prefix", "rare"), affected), "moved")
        drop(affected)
        tables = [moved]
        release(docs.sparkSession)
    if moved is None:
        return base, []
    # What was made anew is told by the same test again, so that no prefix is shuffled to be left out.
    return base.where(~hit("prefix")).unionByName(moved.select(base.columns)), tables


def _holds_crowded(order: Order):
    @pandas_udf("boolean")
    def hit(prefixes: pd.Series) -> pd.Series:
        ends = np.cumsum([0, *(len(p) for p in prefixes)])
        found = np.concatenate([[0], np.cumsum(order.is_crowded(np.concatenate([np.zeros(0, np.int64), *prefixes])), dtype=np.int64)])
        return pd.Series(found[ends[1:]] > found[ends[:-1]])

    return hit


def _of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each wanted (fp, key), prints being distinct there. Equal keys are asked for as no less and no more, so that rows are dealt out by print, once, for the join and for leaving out repeats."""
    w = wanted.select(F.col("fp").alias("wfp"), F.col("key").alias("wkey"))
    return rows.join(dealt(w), (F.col("fp") == F.col("wfp")) & (F.col("key") <= F.col("wkey")) & (F.col("key") >= F.col("wkey")), "left_semi").dropDuplicates(["fp"])


def _long_enough(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-9


def _sets(need: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(fp, shingles) of the prints in `need`, from the texts of the documents that stand for them; repeated rows may repeat."""
    wanted = cut(few_files(need.join(nodes.select("fp", "key"), "fp"), nodes), "need")
    some = may_hold(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), wanted, "key")

    def each(batches):
        for b in batches:
            for f, t in zip(b["fp"], b["text"], strict=True):
                hashes = digests(t, words)
                if print_of(hashes) == f:  # not another text under the same id
                    yield pd.DataFrame({"fp": [f], "shingles": [shingles_of(hashes)]})

    out = cut(some.join(wanted, "key").select("fp", "text").mapInPandas(thrifty(each), "fp long, shingles array<long>"), "sets")
    drop(wanted)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: float, sets) -> DataFrame:
    """Of the pairs (a, b) of prints, those whose sets are that similar. sets: looks up those of given prints."""
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    may = _near_enough(F.col("ka"), F.col("na"), F.col("kb"), F.col("nb"), similarity)
    pairs = cut(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b"), "tried")
    found = sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    both = pairs.join(found.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a").join(found.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("met"), (F.size("sa") + F.size("sb")).alias("sum"))
    out = cut(few_files(met.where(F.col("met") >= (F.col("sum") - F.col("met")) * F.lit(similarity) - 1e-9).select("a", "b"), pairs), "alike")
    drop(pairs, found)
    release(pairs.sparkSession)
    return out


def _members(own: DataFrame) -> DataFrame:
    """(cell, fp, n, at, members, tried): of cells with more than one member, each with two members to be tried against."""
    # A document's row becomes one row a shingle: place and size travel as one number.
    cells = own.select("fp", F.col("n").cast("long").alias("n"), "rare", F.posexplode("prefix").alias("at", "cell"))
    cells = cells.select("cell", "fp", F.shiftleft("n", 32).bitwiseOR(F.col("at")).alias("place"), (F.col("at") < F.col("rare")).alias("few"))
    one = F.struct("fp", "place")
    order = F.xxhash64("fp", "cell")
    # Dealt out before the order is made up, which would be written too.
    rare = cells.where("few").select("cell", "fp", "place").repartition("cell").withColumn("order", order)
    whole = Window.partitionBy("cell").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rare = rare.select("cell", "fp", "place", F.count("*").over(whole).alias("members"), F.first(one).over(whole).alias("x"), F.last(one).over(whole).alias("y"))
    often = cells.where("not few").select("cell", "fp", "place")
    centres = often.groupBy("cell").agg(F.count("*").alias("members"), F.min_by(one, order).alias("x"), F.max_by(one, order).alias("y"))  # as many as common shingles at most
    rows = rare.union(often.join(F.broadcast(centres.where("members > 1")), "cell").select("cell", "fp", "place", "members", "x", "y")).where("members > 1")
    size, at = (lambda c: F.shiftright(c, 32)), (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
    tried = F.array(*[F.struct(F.col(c)["fp"].alias("fp"), size(F.col(c)["place"]).alias("n"), at(F.col(c)["place"]).alias("at")) for c in "xy"])
    return rows.select("cell", "fp", size(F.col("place")).alias("n"), at(F.col("place")).alias("at"), "members", tried.alias("tried"))


def _may_link(xn: Column, xat: Column, yn: Column, yat: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be that similar if what they share comes at these places first: what they share at least can't come later."""
    shares = (xn + yn) * F.lit(similarity / (1 + similarity)) - 1e-6
    return _long_enough(xn, yn, similarity) & (xn - xat >= shares) & (yn - yat >= shares)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _mixed(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(cell, fp, n, at, component, main): of cells of more than three members, those of several components; main is the one with most members."""
    owned = rows.where("members > 3").select("cell", "fp", "n", "at").join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    groups = owned.groupBy("cell", "component").agg(F.count("*").alias("k")).groupBy("cell").agg(F.count("*").alias("groups"), F.max_by("component", "k").alias("main")).where("groups > 1")
    return cut(few_files(owned.join(groups.drop("groups"), "cell"), rows, 2), "mixed")


def _against_hubs(left: DataFrame, edges: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Members of mixed cells with members t of other components: the ones with most links, in the main component or not, and one of either by chance."""
    degree = edges.select(F.col("a").alias("fp")).union(edges.select("b")).groupBy("fp").agg(F.count("*").alias("degree"))
    one, chance, main = F.struct("fp", "n", "at", "component"), F.xxhash64("fp", "cell", F.lit(turn)), F.col("component") == F.col("main")
    hub = [F.max_by(one, F.struct(side, by, chance)) for side in (main, ~main) for by in (F.coalesce("degree", F.lit(0)), F.lit(0))]
    hubs = left.join(degree, "fp", "left").groupBy("cell").agg(F.array_distinct(F.array(*hub)).alias("hubs"))
    return left.join(hubs, "cell").select("fp", "n", "at", "component", F.explode("hubs").alias("t")).where((F.col("component") != F.col("t.component")) & _may_link(F.col("n"), F.col("at"), F.col("t.n"), F.col("t.at"), similarity))


def _others(left: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """All pairs (xf, yf) from different components of a cell which their places, sizes and sketches allow."""
    left = left.join(nodes.select("fp", "sketch"), "fp")
    x = left.where("component <> main").select("cell", F.col("fp").alias("xf"), F.col("n").alias("xn"), F.col("at").alias("xat"), F.col("component").alias("xc"), F.col("sketch").alias("xk"))
    y = left.select("cell", F.col("fp").alias("yf"), F.col("n").alias("yn"), F.col("at").alias("yat"), F.col("component").alias("yc"), (F.col("component") == F.col("main")).alias("of_main"), F.col("sketch").alias("yk"))
    return x.join(y, (x.cell == y.cell) & (x.xc != y.yc) & (y.of_main | (x.xf < y.yf)) & _may_link(x.xn, x.xat, y.yn, y.yat, similarity) & _near_enough(x.xk, x.xn, y.yk, y.yn, similarity))


def link(own: DataFrame, rows: DataFrame, docs: DataFrame, key: str, text: str, words: int, similarity: float, order: Order) -> DataFrame:
    """Links among the given rows of what described() makes, whose prints are distinct: (node, component), the prints that have one."""
    others = cut(few_files(own.select("row").join(rows, "row", "left_anti"), own), "others")
    nodes = cut(few_files(without(own.drop("prefix"), others, "row"), own), "nodes")
    sets = lambda need: _sets(need, nodes, docs, key, text, words)
    base = without(own, others, "row").select("fp", "key", "n", "prefix", "rare")
    base, tables = uncrowded(base, docs, key, text, words, similarity, order)
    release(docs.sparkSession)
    rows = cut(_members(base), "cells")
    drop(*tables)
    release(docs.sparkSession)
    # In cells of up to three members all pairs are tried so.
    stars = rows.select("fp", "n", "at", F.explode("tried").alias("t")).where((F.col("fp") != F.col("t.fp")) & _may_link(F.col("n"), F.col("at"), F.col("t.n"), F.col("t.at"), similarity))
    edges = _verified(_pairs(stars, "fp", "t.fp"), nodes, similarity, sets)
    near = components(edges, of=edges)
    left = _mixed(rows, near)
    for turn in range(HUB_ROUNDS):
        more = _verified(_pairs(_against_hubs(left, edges, similarity, turn), "fp", "t.fp"), nodes, similarity, sets)
        if more.isEmpty():
            drop(more)
            break
        links = cut(edges.union(more), "links")
        drop(near, left, edges, more)
        edges, near = links, components(links, of=links)
        left = _mixed(rows, near)
    drop(rows)
    release(docs.sparkSession)
    more = _verified(_pairs(_others(left, nodes, similarity), "xf", "yf"), nodes, similarity, sets)
    if not more.isEmpty():
        drop(near)
        near = components(edges.union(more))
    drop(left, nodes, others, edges, more)
    return near
