"""Benchmark decontamination by a random-walk embedding of edit distance (operator 5).

A benchmark item leaks into a document if some stretch of the document is within `similarity` of the item: word edit
distance at most (1 - similarity) x item words. Words are lower-cased and stripped of punctuation at their ends.

Index: from every offset of an item a CGK walk reads the words onwards; step j emits the current word and moves on if a
random bit of (j, word) says so. The walk turns edits into few differing emissions, as two walks fall into step again
after an edit. A repetition samples some of the steps, and the emitted words at these are the window's key. A document is
walked from every word in the same way, all documents of a batch at once in numpy, and equal keys propose an alignment
of the whole item-sized window. A seeded simulation edits items of every length to the limit, at distinct words, drawn at
random or evenly spread, by substitutions alone or mixed with deletions and insertions; a length gets as many repetitions
as it takes until the least share found is at least `recall`, REPEATED at most. Items of lengths that these do not reach,
and those beyond the simulation's bound, are searched exactly: an item of n words within d edits is cut into d + 1 pieces,
one of which stands unedited in the document and proposes the window. A proposal passes if enough of the item's words are
near, and is then verified by the exact edit distance of the item to the best stretch of its window's surroundings, so
nothing below the similarity is reported.

The benchmark is held in blocks of at most `block_words` words, one pass over the documents a block; documents are read
in place and never shuffled. null or empty text: no leak. Items without words leak nowhere; of repeated items each is
reported. Items of under five words must match exactly, word for word and in order, whatever the similarity. Of several
stretches the nearest is reported, of equally near ones the first. Texts of any length are read whole. Further columns of
either table stay out of the result. Empty tables: no rows. Repeated rows are reported each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, thrifty

EDGE = re.compile(r"^\W+|\W+$")
MARKS = ".,;:!?"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return [w for w in (EDGE.sub("", x) for x in (text or "").lower().split()) if w]


class Vocabulary(dict):
    """raw word -> id of a benchmark word, 0 for others, -1 for punctuation alone (no word)."""

    def __init__(self, words: dict[str, int], most: int = 300_000):
        super().__init__(words)
        self.words, self.most = words, most

    def __missing__(self, raw: str) -> int:
        w = raw.rstrip(MARKS)
        if not w.isalnum():
            w = EDGE.sub("", raw)
        n = self.words.get(w, 0) if w else -1
        if len(self) >= self.most + len(self.words):
            self.clear()
            self.update(self.words)
        self[raw] = n
        return n


@dataclass
class Walk:
    """One repetition for items of one length class: bits[j, id] and the sampled steps."""

    bits: np.ndarray
    sampled: np.ndarray
    hashes: np.ndarray = field(default=None)  # sorted keys
    items: np.ndarray = field(default=None)
    offsets: np.ndarray = field(default=None)
    sieve: np.ndarray = field(default=None)
    first: np.ndarray = field(default=None)  # by word, whether a key begins with it

    def keys(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the walks from positions `at` those that emit a benchmark word at all sampled steps, with their keys. ids ends in enough zeros."""
        cur, key, take = at.astype(np.int64), np.zeros(len(at), np.uint64), set(self.sampled.tolist())
        for j in range(self.sampled[-1] + 1):
            w = ids[cur]
            if j in take:
                if not (keep := w > 0).all():
                    at, cur, key, w = at[keep], cur[keep], key[keep], w[keep]
                key = (key ^ w.astype(np.uint64)) * PRIME
                key ^= key >> np.uint64(29)
            cur = cur + self.bits[j][w]
        return at, key

    def index(self, docs: list[np.ndarray], which: list[int], starts: list[list[int]] | None = None) -> None:
        """starts: for each of docs the offsets that are walked from; all if not given."""
        hashes, items, offsets, self.first = [], [], [], np.zeros(self.bits.shape[1], bool)
        for n, (i, ids) in enumerate(zip(which, docs, strict=True)):
            padded = np.concatenate([ids, np.zeros(len(self.bits) + 1, ids.dtype)])
            at, key = self.keys(padded, np.array(starts[n], np.int64) if starts else np.arange(len(ids)))
            self.first[padded[at]] = True
            hashes.append(key)
            items.append(np.full(len(at), i))
            offsets.append(at)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.items, self.offsets = h[order], np.concatenate(items)[order] if hashes else h.astype(int), np.concatenate(offsets)[order] if hashes else h.astype(int)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(h >> np.uint64(44)).astype(np.int64)] = True

    def proposals(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start of the window, the position walked from) for each equal key."""
        at, key = self.keys(ids, known[self.first[ids[known]]])
        keep = self.sieve[(key >> np.uint64(44)).astype(np.int64)]
        at, key = at[keep], key[keep]
        lo, hi = np.searchsorted(self.hashes, key, "left"), np.searchsorted(self.hashes, key, "right")
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = np.repeat(at, n)
        return self.items[rows], met - self.offsets[rows], met


def runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of several runs in one row, and which run each is of."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def stretch_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the window, with the stretch's start and end."""
    n = len(window)
    row, begin, steps = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, w in enumerate(item):
        differs = row[:-1] + ((window != w) | (w <= 0))
        up = row + 1
        cost, start = up.copy(), begin.copy()
        better = differs < up[1:]
        cost[1:][better], start[1:][better] = differs[better], begin[:-1][better]
        cost[0] = i + 1
        # insertions: a cell from the best cell to its left
        slid = np.minimum.accumulate((cost - steps) * (n + 2) + np.arange(n + 1))
        source = slid % (n + 2)
        row, begin = cost[source] + steps - source, start[source]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


class LeakIndex:
    """Walks over a block of items, and the exact check."""

    #: Item words from which on, steps, sampled steps.
    CLASSES = ((12, 12, 5), (5, 6, 3), (1, 4, None))
    #: Simulated items for each length and way to edit, and the words of all of them at most.
    TRIALS, TRIAL_WORDS, REPEATED = 100, 4_000_000, 4

    def __init__(self, ids: list, texts: list, similarity: float = 0.8, recall: float = 0.97, seed: int = 7):
        split = [words_of(t) for t in texts]
        self.words = {w: n + 1 for n, w in enumerate(sorted({w for x in split for w in x}))}
        self.items = [np.array([self.words[w] for w in x], np.int32) for x in split]
        self.ids, self.similarity = ids, similarity
        self.allowed = [int((1 - similarity) * len(x) + 1e-9) for x in self.items]
        self.sizes, self.spare = np.array([len(x) for x in self.items], np.int64), np.array(self.allowed, np.int64)
        self.firsts, self.flat = np.cumsum(self.sizes) - self.sizes, np.concatenate([*self.items, np.zeros(0, np.int32)]).astype(np.int64)
        self.walks: list[Walk] = []
        self.found: dict[int, float] = {}  # by length, the least share found; lengths that are searched exactly have none
        rng = np.random.default_rng(seed)
        for c, (least, steps, k) in enumerate(self.CLASSES):
            most = self.CLASSES[c - 1][0] if c else 1 << 30
            own = [i for i, x in enumerate(self.items) if least <= len(x) < most]
            if not own:
                continue
            if k is None:  # a few words: all of them, in order; one length after another
                for n in sorted({len(self.items[i]) for i in own}):
                    same = [i for i in own if len(self.items[i]) == n]
                    walk = Walk(np.ones((n, len(self.words) + 1), np.int64), np.arange(n))
                    walk.index([self.items[i] for i in same], same)
                    self.walks.append(walk)
                continue
            lengths: dict[int, list[int]] = {}
            for i in own:
                lengths.setdefault(len(self.items[i]), []).append(i)
            trials, spent = {}, 0
            for n, same in sorted(lengths.items()):
                if (spent := spent + n * self.TRIALS * 4) <= self.TRIAL_WORDS:
                    trials[n] = self._trials(same, rng)
            walks, settled = [], {}  # length -> its number of repetitions
            while len(walks) < self.REPEATED and trials.keys() - settled.keys():
                walk = Walk(rng.integers(0, 2, (steps, len(self.words) + 1)), np.concatenate([[0], 1 + np.sort(rng.choice(steps - 1, k - 1, replace=False))]))
                open_ = sorted(trials.keys() - settled.keys())
                some = [i for n in open_ for i in lengths[n]]
                walk.index([self.items[i] for i in some], some)
                walks.append(walk)
                for n in open_:
                    if (share := self._share_found(walk, trials[n])) >= recall:
                        settled[n], self.found[n] = len(walks), share
            for number, walk in enumerate(walks, 1):
                if some := [i for i in own if settled.get(len(self.items[i]), 0) >= number]:
                    walk.index([self.items[i] for i in some], some)
                    self.walks.append(walk)
            exact = [i for i in own if len(self.items[i]) not in settled]
            pieces: dict[int, dict[int, list[int]]] = {}
            for i in exact:
                n, parts = len(self.items[i]), self.allowed[i] + 1
                ends = [n * j // parts for j in range(parts + 1)]
                for a, b in zip(ends, ends[1:], strict=False):
                    pieces.setdefault(b - a, {}).setdefault(i, []).append(a)
            for size, at in sorted(pieces.items()):
                piece = Walk(np.ones((size, len(self.words) + 1), np.int64), np.arange(size))
                piece.index([self.items[i] for i in at], list(at), list(at.values()))
                self.walks.append(piece)
        self.pad = max((len(w.bits) for w in self.walks), default=0) + 1

    def _trials(self, same: list[int], rng: np.random.Generator) -> list[tuple]:
        """Items of one length, edited to the limit in four ways: which items, their words in one row, where each ends, whether found yet."""
        out, gap = [], np.zeros(max(steps for _, steps, _ in self.CLASSES) + 1, np.int32)
        for spread in (False, True):
            for mixed in (False, True):
                which = [same[t % len(same)] for t in range(self.TRIALS)]
                edited = [np.concatenate([self._edited(i, rng, spread, mixed), gap]) for i in which]
                out.append((np.array(which), np.concatenate(edited), np.cumsum([len(x) for x in edited]), np.zeros(len(which), bool)))
        return out

    def _share_found(self, walk: Walk, trials: list[tuple]) -> float:
        """The share found by this walk and those before: the least of the ways to edit."""
        for which, ids, ends, found in trials:
            item, _, met = walk.proposals(ids, np.flatnonzero(ids > 0))
            trial = np.searchsorted(ends, met, side="right")
            found[trial[item == which[trial]]] = True
        return min(float(found.mean()) for *_, found in trials)

    def _edited(self, i: int, rng: np.random.Generator, spread: bool, mixed: bool) -> np.ndarray:
        """The item with as many edits as allowed, each at a word of its own."""
        x, many = [[w] for w in self.items[i].tolist()], self.allowed[i]
        if spread:
            step, shift = len(x) / max(1, many), rng.uniform(0, 1)
            places = [int(step * (j + shift)) for j in range(many)]
        else:
            places = rng.choice(len(x), many, replace=False).tolist()
        for at in places:
            x[at] = [[0], [], [0, *x[at]]][int(rng.integers(3)) if mixed else 0]
        return np.array([w for part in x for w in part], np.int32)

    def _likely(self, proposals: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 400_000):
        """(document, item, window's start and end, start and end of its surroundings) of proposals with enough of the item's words nearby: each word that is not costs an edit."""
        doc, item, at = proposals.T
        size, spare, start, end = self.sizes[item], self.spare[item], starts[doc], ends[doc]
        lo, hi = np.maximum(at - spare, start), np.minimum(at + size + spare, end)
        rows = np.stack([doc, item, lo, hi, np.maximum(lo - spare, start), np.minimum(hi + spare, end)], axis=1)[hi - lo >= size - spare]
        words = self.sizes[rows[:, 1]] + rows[:, 5] - rows[:, 4]
        for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.unique(np.r_[0, np.searchsorted(np.cumsum(words), np.arange(at_once, words.sum(), at_once)), len(rows)]).astype(int)), strict=True):
            part = rows[a:b]
            own, mine = runs(self.firsts[part[:, 1]], self.sizes[part[:, 1]])
            near, theirs = runs(part[:, 4], part[:, 5] - part[:, 4])
            key = lambda w, n: n * (len(self.words) + 1) + w
            wanted, nearby = key(self.flat[own], mine), np.sort(key(ids[near].astype(np.int64), theirs))
            there = nearby[np.minimum(np.searchsorted(nearby, wanted), len(nearby) - 1)] == wanted
            yield part[np.bincount(mine, there, minlength=len(part)) >= self.sizes[part[:, 1]] - self.spare[part[:, 1]]]

    def scan(self, docs: list[list[str]], vocabulary: Vocabulary):
        """(document, item, distance, first word, word after the last) of each leak, the nearest stretch for each item."""
        sizes, rows = np.zeros(len(docs), np.int64), []
        for n, d in enumerate(docs):
            ids = np.fromiter(map(vocabulary.__getitem__, d), np.int32, len(d))
            rows.append(ids[ids >= 0])
            sizes[n] = len(rows[-1])
        ends = np.cumsum(sizes + self.pad)
        starts = ends - sizes - self.pad
        ids = np.concatenate([np.concatenate([r, np.zeros(self.pad, np.int32)]) for r in rows]) if rows else np.zeros(0, np.int32)
        known = np.flatnonzero(ids > 0)
        found = [w.proposals(ids, known) for w in self.walks]
        if not found:
            return
        item, at, met = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.searchsorted(ends, met, side="right")
        proposals = np.unique(np.stack([doc, item, at], axis=1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for part in self._likely(proposals, ids, starts, starts + sizes):
            for d, i, lo, hi, first, last in part.tolist():
                x, s = self.items[i], self.allowed[i]
                if any(lo >= p - s and hi <= q + s for p, q in done.get((d, i), ())):
                    continue
                cost, b, e = stretch_distance(x, ids[first:last])
                done.setdefault((d, i), []).append((lo, hi))
                if cost <= s and (cost, b + first) < best.get((d, i), (1 << 30, 0))[:2]:
                    best[d, i] = (cost, b + first, e + first)
        for (d, i), (cost, b, e) in sorted(best.items()):
            yield d, i, cost, b - int(starts[d]), e - int(starts[d])


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.97, block_words: int = 200_000) -> DataFrame:
    """A row per document and item that leaks into it: key, item key (with "item_" before it if both have one name), distance, similarity, first_word, end_word (words counted without bare punctuation)."""
    chosen = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = chosen.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] or 0
    blocks = -(-total // block_words) or 1
    shown = item_key if item_key != key else f"item_{key}"
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{shown}` {item_kind}, distance int, similarity double, first_word long, end_word long"
    out = None
    for n in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).toPandas() if blocks > 1 else chosen.toPandas()
        part = part.sort_values(["item", "text"], kind="stable")
        index = LeakIndex(part["item"].tolist(), part["text"].tolist(), similarity, recall)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            index = shared.value
            vocabulary = Vocabulary(index.words)
            for frame in batches:
                for at in range(0, len(frame), 256):
                    few = frame.iloc[at : at + 256]
                    rows = [(few["key"].iloc[d], index.ids[i], c, 1 - c / len(index.items[i]), b, e) for d, i, c, b, e in index.scan([t.lower().split() if t else [] for t in few["text"]], vocabulary)]
                    if rows:
                        yield pd.DataFrame(rows, columns=[key, shown, "distance", "similarity", "first_word", "end_word"])

        found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(thrifty(scan), schema)
        out = found if out is None else out.union(found)
    return out


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
