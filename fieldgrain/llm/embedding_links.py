"""Exact threshold links between embeddings by dual traversal of cover trees (operator 9).

Unit vectors are compared by chord length, a metric: cosine >= threshold is a chord of at most reach = sqrt(2 - 2 t).
Equal vectors are one point with a weight. The top of the tree is built from a bounded, hashed sample: its dense points
and a farthest-first net become the cells' centres (documented bound: `most_cells`), every point joins its nearest one.
Points within reach / 2 of their centre are the cell's core: any two of them link, so a crowd of near copies is counted
and connected by arithmetic, without a pair being made. The rest is the cell's shell.

A point visits a later cell only if covering radius and bisector of the two centres allow a link there. Visits are counted
first; then cells and their visitors are dealt out in blocks of bounded size, a cell's residents once for each block of
its visitors and not at all where nobody comes. A task builds a cover tree of each of its two blocks - nested levels
of halving radii - and traverses both at once: node pairs that are further apart than their covering radii and reach are
dropped, node pairs that are closer altogether are counted whole, all others are opened, down to points, whose cosine is
taken in double precision. Tasks give partial counts and one edge a linked point; pairs are never written. Cells grow
in number with the points up to `most_cells` x `block` points: so far the rows dealt out grow in proportion where the
data are clustered; beyond, each cell has several blocks and they grow faster. On structureless high-dimensional data any
exact method of this kind has to compare most blocks, and so has this one (n^2 / block rows are then dealt out).

Vectors that are null, zero, or hold a null or non-finite component, and rows with a null id, link with nothing. A
shorter vector counts as padded with zeros. Repeated rows are vectors of their own. Ties: a cosine of exactly the threshold
links; equally near centres, the first. Further columns stay out of the result. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, some_ids, table
from .components import components

EPS = 1e-9


def packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): the vector's doubles as bytes, null if it can't link."""
    kind = df.schema[key].dataType.simpleString()
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [None if x is None else np.asarray(x, np.float64).tobytes() for x in b["v"]]})

    return df.select(F.col(key).alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v")).mapInPandas(pack, f"id {kind}, vec binary")


def units(vecs, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vecs), np.float64).reshape(-1, width // 8)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def pick_centres(x: np.ndarray, count: int, near: float) -> np.ndarray:
    """Dense points of a sample first (each with at least 1 % of it within `near`), then farthest-first."""
    if not len(x):
        return x
    crowd = np.concatenate([(chords(x[i : i + 512], x) <= near).sum(axis=1) for i in range(0, len(x), 512)])
    chosen: list[int] = []
    least = np.full(len(x), np.inf)
    for i in np.argsort(-crowd, kind="stable"):
        if crowd[i] < max(5, len(x) / 100) or len(chosen) >= 100:
            break
        if least[i] > near:
            chosen.append(int(i))
            least = np.minimum(least, chords(x, x[[i]])[:, 0])
    while len(chosen) < min(count, len(x)):
        i = int(np.argmax(least)) if chosen else 0
        if chosen and least[i] <= EPS:
            break
        chosen.append(i)
        least = np.minimum(least, chords(x, x[[i]])[:, 0])
    return x[chosen]


class Node:
    __slots__ = ("centre", "children", "members", "radius", "weight")

    def __init__(self, x: np.ndarray, members: np.ndarray, weights: np.ndarray, scale: float, leaf: int, centre: int):
        self.members, self.centre, self.weight = members, centre, int(weights[members].sum())
        self.radius, self.children = 0.0, []
        if len(members) == 1:
            return
        own = x[members] - x[centre]
        far = float(np.sqrt(np.einsum("nd,nd->n", own, own).max()))
        self.radius = far * (1 + EPS) + EPS
        if len(members) <= leaf or far <= EPS:
            return
        while scale > far / 2:
            scale /= 2
        # Who is near whom shapes the tree only, radii are taken from the members: single precision will do, of differences
        # from the centre in units of the largest one, as products of the vectors themselves round to 1 in a tight cluster.
        own = (own / far).astype(np.float32)
        half, ones = np.einsum("nd,nd->n", own, own)[:, None] / 2, np.ones((len(own), 1), np.float32)
        one, other = np.concatenate([own, -half, ones], axis=1), np.concatenate([own, ones, -half], axis=1)
        near = np.concatenate([one[i : i + 1024] @ other.T >= -((scale / far) ** 2) / 2 for i in range(0, len(own), 1024)])
        left = np.ones(len(members), bool)
        first = int(np.flatnonzero(members == centre)[0])  # nested: a node's centre is a child's centre
        for i in (first, *range(len(members))):
            if left[i]:
                mine = near[i] & left
                mine[i] = True
                left &= ~mine
                self.children.append(Node(x, members[mine], weights, scale, leaf, int(members[i])))


class Links:
    """Weighted counts of links and union-find over the points of one task."""

    def __init__(self, x: np.ndarray, weights: np.ndarray, threshold: float):
        self.x, self.weights, self.threshold, self.reach = x, weights, threshold, (2 - 2 * threshold) ** 0.5
        self.n, self.parent, self.touched = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)

    def tree(self, members: np.ndarray, leaf: int = 8) -> Node:
        return Node(self.x, members, self.weights, 2.0, leaf, int(members[0]))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect all of a with all of b."""
        roots = {self.root(i) for i in (*a.tolist(), *b.tolist())}
        least = min(roots)
        for r in roots:
            self.parent[r] = least
        self.touched[a] = self.touched[b] = True

    def all_linked(self, a: Node, b: Node) -> None:
        self.n[a.members] += b.weight
        if a is b:
            self.n[a.members] -= self.weights[a.members]
        else:
            self.n[b.members] += a.weight
        if a is not b or len(a.members) > 1:
            self.join(a.members, b.members)

    def points(self, a: Node, b: Node) -> None:
        met = (self.x[a.members] @ self.x[b.members].T) >= self.threshold
        if a is b:
            met &= ~np.eye(len(a.members), dtype=bool)
        if not met.any():
            return
        self.n[a.members] += met @ self.weights[b.members]
        if a is not b:
            self.n[b.members] += self.weights[a.members] @ met
        for i in np.flatnonzero(met.any(axis=1)):
            self.join(a.members[[i]], b.members[met[i]])

    def traverse(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a is b and 2 * a.radius <= self.reach - EPS:
                self.all_linked(a, b)
                continue
            if not a.children and not b.children:
                self.points(a, b)
                continue
            left, right = a.children or [a], b.children or [b]
            ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
            ca, cb = self.x[[n.centre for n in left]], self.x[[n.centre for n in right]]
            low, span = cb.astype(np.float32).T, self.reach + rb.max()
            for at in range(0, len(left), 1024):
                # A first look in single precision with the largest radii, then bounds of each pair that is left.
                least = 1 - (span + ra[at : at + 1024].max()) ** 2 / 2 - 1e-5
                i, j = np.nonzero(ca[at : at + 1024].astype(np.float32) @ low >= least)
                i += at
                if a is b:
                    i, j = i[i <= j], j[i <= j]
                for k in range(0, len(i), 1 << 16):
                    ik, jk = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    apart, both = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", ca[ik], cb[jk]))), ra[ik] + rb[jk]
                    maybe = apart - both <= self.reach + EPS
                    whole = apart + both <= self.reach - EPS
                    for m, n, all_of in zip(ik[maybe].tolist(), jk[maybe].tolist(), whole[maybe].tolist(), strict=True):
                        if all_of and left[m] is not right[n]:
                            self.all_linked(left[m], right[n])
                        elif left[m] is not right[n] or len(left[m].members) > 1:
                            stack.append((left[m], right[n]))


@dataclass
class Dealt:
    """Vectors on their way to the tasks that compare them. rows: (to, salt, chunk, role, rep, n, core, vec)."""

    own: DataFrame
    homed: DataFrame
    rows: DataFrame
    stats: pd.DataFrame
    width: int


def deal_out(own: DataFrame, points: DataFrame, threshold: float, block: int, sample: int, most_cells: int) -> Dealt | None:
    """Cells, who visits whom, and blocks of residents beside blocks of visitors. None without vectors that can link."""
    kind = own.schema["id"].dataType.simpleString()
    total, width = points.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    if not total:
        return None
    reach = (2 - 2 * threshold) ** 0.5
    seen = some_ids(points.select("rep", "vec"), sample, "rep").toPandas()
    centres = pick_centres(units(seen["vec"], width), min(most_cells, -(-total // 16)), reach / 2)
    between = chords(centres, centres)

    def home(batches):
        for b in batches:
            if len(b):
                far = chords(units(b["vec"], width), centres)
                cell = far.argmin(axis=1)
                least = far[np.arange(len(b)), cell]
                yield b.assign(cell=cell.astype("int32"), core=least <= reach / 2 - EPS, far=least)

    homed = cut(points.mapInPandas(home, f"vec binary, rep {kind}, n long, cell int, core boolean, far double"), "homed")
    stats = homed.groupBy("cell", "core").agg(F.count("*").alias("points"), F.sum("n").alias("weight"), F.max("far").alias("radius"), F.min("rep").alias("first")).toPandas()
    stats = stats.sort_values(["core", "cell"]).reset_index(drop=True)
    shells, cores = stats[~stats["core"]].set_index("cell"), stats[stats["core"]].set_index("cell")
    # Groups: shells of neighbouring cells together, up to a block; then each core. A point visits later groups only.
    lead = between[:, : max(1, int(len(centres) ** 0.5))].argmin(axis=1)
    near = [int(c) for c in np.lexsort((np.arange(len(centres)), lead)) if c in shells.index]
    firsts, points, of_shell = [], [], np.full(len(centres), -1)
    for i, c in enumerate(near):
        size = int(shells["points"][c])
        if not points or points[-1] + size > block:
            firsts.append(i)
            points.append(0)
        points[-1] += size
        of_shell[c] = len(points) - 1
    n_shells, core_cells = len(points), cores.index.to_numpy()
    of_core = np.full(len(centres), -1)
    of_core[core_cells] = n_shells + np.arange(len(core_cells))
    points = np.array([*points, *cores["points"]], np.int64)
    inner, salts = np.arange(len(points)) < n_shells, np.maximum(1, -(-points // block))
    shell_radius, core_radius = shells["radius"].reindex(near).to_numpy(), cores["radius"].to_numpy()

    def visits(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The rows' groups, and (rows, groups) whether a row has to visit a group."""
        far, d_home, at = chords(units(b["vec"], width), centres), b["far"].to_numpy()[:, None], b["cell"].to_numpy()
        group, span = np.where(b["core"], of_core[at], of_shell[at]), between[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = np.where(span > 0, (far**2 - d_home**2) / (2 * span), 0) <= reach + EPS
        meets = lambda cells, radius: (far[:, cells] <= radius + reach + EPS) & beyond[:, cells]
        shell = np.logical_or.reduceat(meets(near, shell_radius), firsts, axis=1) if near else np.zeros((len(b), 0), bool)
        return group, np.concatenate([shell, meets(core_cells, core_radius)], axis=1) & (group[:, None] < np.arange(len(points)))

    def slices(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                yield b.iloc[at : at + 1024]

    def count(batches):
        n = np.zeros(len(points), np.int64)
        for b in slices(batches):
            n += visits(b)[1].sum(axis=0)
        yield pd.DataFrame({"g": np.flatnonzero(n).astype("int32"), "n": n[n > 0]})

    visitors = np.zeros(len(points), np.int64)
    for r in homed.mapInPandas(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():  # at most 2 x most_cells rows
        visitors[r.g] = r.n
    # Visitors of a group are dealt to so many blocks, and its residents go to each of these: none to a core that nobody visits.
    among = visitors + np.where(inner & (salts > 1), points, 0)
    chunks = np.where((among > 0) | inner, np.maximum(1, -(-among // block)), 0)

    def deal(batches):
        for b in slices(batches):
            group, to = visits(b)
            mixed = pd.util.hash_array(b["rep"].to_numpy())
            salt, spread = (mixed % salts[group].astype(np.uint64)).astype("int32"), mixed >> np.uint64(20)

            def rows(at, g, s, c, role, b=b):
                out = b.iloc[at][["rep", "n", "core", "vec"]]
                return out.assign(**{k: np.broadcast_to(v, len(at)).astype("int32") for k, v in (("to", g), ("salt", s), ("chunk", c), ("role", role))})

            for c in range(int(chunks[group].max())):
                at = np.flatnonzero(chunks[group] > c)
                yield rows(at, group[at], salt[at], c, 0)
            for g in np.flatnonzero(among):
                at, piece = np.flatnonzero(to[:, g]), (spread % np.uint64(max(1, chunks[g]))).astype("int32")
                for s in range(salts[g]):
                    if len(at):
                        yield rows(at, g, s, piece[at], 1)
                    same = np.flatnonzero((group == g) & inner[group] & (salt < s))
                    if len(same):
                        yield rows(same, g, s, piece[same], 1)

    dealt = homed.mapInPandas(deal, f"to int, salt int, chunk int, role int, rep {kind}, n long, core boolean, vec binary")
    return Dealt(own, homed, dealt, stats, width)


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block: int = 6000, sample: int = 6000, most_cells: int = 1024) -> DataFrame:
    """A row per vector: key, n_links, component_id, kept. sample, most_cells: bounds of what the driver holds."""
    kind = df.schema[key].dataType.simpleString()
    own = cut(packed(df, key, vector), "vectors")
    points = cut(own.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "points")
    dealt = deal_out(own, points, threshold, block, sample, most_cells)
    if dealt is None:
        return own.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    homed, stats, width = dealt.homed, dealt.stats, dealt.width

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["role", "rep"], kind="stable")
        stay, visit = np.flatnonzero(frame["role"] == 0), np.flatnonzero(frame["role"] == 1)
        links = Links(units(frame["vec"], width), frame["n"].to_numpy(), threshold)
        intra = len(stay) > 1 and frame["chunk"].iloc[0] == 0 and not frame["core"].iloc[0]
        if len(stay) and (intra or len(visit)):
            mine = links.tree(stay)
            if intra:
                links.traverse(mine, mine)
            if len(visit):
                links.traverse(mine, links.tree(visit))
        at = np.flatnonzero(links.touched)
        reps = frame["rep"].to_numpy()
        return pd.DataFrame({"rep": reps[at], "n": links.n[at], "root": reps[[links.root(i) for i in at]]})

    part = cut(dealt.rows.groupBy("to", "salt", "chunk").applyInPandas(compare, f"rep {kind}, n long, root {kind}"), "links")
    drop(points)
    counted = part.groupBy("rep").agg(F.sum("n").alias("met"))
    cores = df.sparkSession.createDataFrame([(int(c), int(w), f.item() if hasattr(f, "item") else f) for c, w, f in stats.loc[stats["core"], ["cell", "weight", "first"]].itertuples(index=False)], f"cell int, weight long, first {kind}")
    crowd = homed.where("core").join(F.broadcast(cores), "cell")  # at most most_cells rows
    linked = components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(crowd.select("rep", "first")))
    found = homed.select("vec", "rep", "n", "cell", "core").join(F.broadcast(cores.select("cell", "weight")), "cell", "left").join(counted, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("vec", (F.col("n") - 1 + F.coalesce("met", F.lit(0)) + F.when(F.col("core"), F.col("weight") - F.col("n")).otherwise(0)).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = cut(own.join(found, "vec", "left").select("id", "n_links", "component_id"), "found")
    drop(own, homed, part, linked)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
