"""Secret scan: three base patterns, and a character convolutional network over every other candidate (operator 7).

Base findings always stay. Candidates are the maximal runs of token characters of at least LONG characters, and those of
at least SHORT that hold a letter and a digit. Each is read with its surrounding characters by a small convolutional
network in numpy: byte embeddings with a flag for inside or context, filters over five characters, maximum and mean over
the candidate, a logistic output. A candidate of any length is read whole, in slices with a running maximum and sum.

It is trained on all distinct candidates and all words beside findings: the base patterns' values are positive, other
candidates and those words negative. Every one comes up in a batch. More than SHARD candidates are dealt into shards by a
hash; each shard trains a copy over a part of its windows, the copies' mean is where the next of ROUNDS rounds starts. What is to be added has no keyword beside it and need not be spelled like a base kind, so each
positive is shown as found, in the surroundings of another run, and there also with its characters put into another
alphabet. It is calibrated on the half it was not trained on; the threshold is the largest that keeps the wanted recall
of positives in foreign surroundings, of all of that half, from counts by bins of logits. Texts are scanned once: their findings and candidates, far smaller than the texts, are
written and used for training and scoring. Redaction reads texts with findings again, and those only.

null text: as the empty text, no findings. Without base findings in the corpus nothing is learnt or added. Repeated rows
are scanned each. Empty table: no rows. Positions are code points, ends exclusive. Ties: spans of one start are in the
order of their kinds. Further columns stay out of findings() and in redact_documents(), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, drop, may_hold, table, thrifty

#: Fixed values of the contract: kinds in their order, patterns, least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
LONG, SHORT = 16, 8
LONG_RUN, SHORT_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}"), re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
CONTEXT = 20
#: Candidates that are learnt from at once, rounds over more of them, bytes of a window that training sees, and the width of the bins of logits.
SHARD, ROUNDS, SEEN, BIN = 20_000, 8, 400, 1 / 64
#: What a finding's characters are put into: lower case, upper case or both with digits, and all token characters.
ALPHABETS = tuple(np.frombuffer(a.encode(), np.uint8) for a in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))

Window = tuple[bytes, int, int]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bytes, int, int]]:
    """(start, end, label, characters with context, inside from, inside to): base values (label: 1 + kind), other runs (label 0)."""
    out = []

    def window(a: int, b: int, label: int) -> None:
        lo = max(0, a - CONTEXT)
        out.append((a, b, label, text[lo : b + CONTEXT].encode("latin-1", "replace"), a - lo, b - lo))

    starts, ends = [], []  # the base spans' union, in order
    for s, k, e in base:
        a = e - len(ASSIGN.match(text, s)[2]) if k == 0 else s
        window(a, e, 1 + k)
        if ends and s <= ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    for m in (SHORT_RUN if DIGIT.search(text) else LONG_RUN).finditer(text):
        i = bisect_right(ends, m.start())
        if i < len(ends) and starts[i] < m.end():
            continue
        if m.end() - m.start() >= LONG or (DIGIT.search(m[0]) and LETTER.search(m[0])):
            window(m.start(), m.end(), 0)
    return out


def moved(w: Window, other: Window) -> Window:
    """A run in another run's surroundings."""
    (raw, a, b), (there, c, d) = w, other
    return there[:c] + raw[a:b] + there[d:], c, c + b - a


def respelled(w: Window, rng: np.random.Generator) -> Window:
    """The run's characters put into another alphabet, one for one; longer runs also cut."""
    raw, a, b = w
    run, letters = np.frombuffer(raw[a:b], np.uint8), ALPHABETS[rng.integers(len(ALPHABETS))]
    if len(run) > LONG:
        run = run[: rng.integers(LONG, len(run) + 1)]
    new = letters[rng.integers(len(letters), size=256)][run].tobytes()
    return raw[:a] + new + raw[b:], a, a + len(new)


def seen(w: Window) -> Window:
    """What training sees of a window: its first SEEN bytes."""
    raw, a, b = w
    return raw[:SEEN], a, min(b, SEEN)


class CharCnn:
    def __init__(self, dim: int = 8, filters: int = 16, width: int = 5, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": rng.normal(0, 0.3, (257, dim)), "w": rng.normal(0, (width * (dim + 1)) ** -0.5, (width * (dim + 1), filters)), "c": np.zeros(filters), "o": rng.normal(0, 0.1, 2 * filters), "b": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def pad(windows: list[Window], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Character ids (256: none) and whether inside."""
        n = max(max(len(w[0]) for w in windows), width) + width - 1
        x, inside = np.full((len(windows), n), 256, np.int16), np.zeros((len(windows), n), np.float32)
        for i, (raw, a, b) in enumerate(windows):
            x[i, width // 2 : width // 2 + len(raw)] = np.frombuffer(raw, np.uint8)
            inside[i, width // 2 + a : width // 2 + b] = 1
        return x, inside

    def forward(self, x: np.ndarray, inside: np.ndarray):
        k = self.width
        seen = np.concatenate([self.p["e"][x], inside[:, :, None]], axis=2)
        n = x.shape[1] - k + 1
        cols = np.concatenate([seen[:, j : j + n] for j in range(k)], axis=2)
        act = np.maximum(0, cols @ self.p["w"] + self.p["c"])
        mask = inside[:, k // 2 : k // 2 + n, None]
        size = np.maximum(1, mask.sum(axis=1))
        inner = act * mask
        at = inner.argmax(axis=1)
        top, mean = np.take_along_axis(inner, at[:, None], axis=1)[:, 0], inner.sum(axis=1) / size
        pooled = np.concatenate([top, mean], axis=1)
        return pooled @ self.p["o"] + self.p["b"][0], (x, cols, act, mask, size, at, pooled)

    def whole(self, x: np.ndarray, inside: np.ndarray, slice_: int = 512) -> np.ndarray:
        """forward()'s logits in bounded memory: slices of positions with a running maximum and sum."""
        k, f = self.width, len(self.p["c"])
        n = x.shape[1] - k + 1
        top, total, size = np.zeros((len(x), f)), np.zeros((len(x), f)), np.zeros((len(x), 1))
        for a in range(0, n, slice_):
            b = min(n, a + slice_)
            seen = np.concatenate([self.p["e"][x[:, a : b + k - 1]], inside[:, a : b + k - 1, None]], axis=2)
            act = np.concatenate([seen[:, j : j + b - a] for j in range(k)], axis=2) @ self.p["w"]
            act += self.p["c"]
            mask = inside[:, k // 2 + a : k // 2 + b, None]
            np.maximum(act, 0, out=act)
            act *= mask
            np.maximum(top, act.max(axis=1), out=top)
            total += act.sum(axis=1)
            size += mask.sum(axis=1, dtype=np.float64)
        return np.concatenate([top, total / np.maximum(1, size)], axis=1) @ self.p["o"] + self.p["b"][0]

    def logits(self, windows: list[Window], at_once: int = 128, area: int = 1 << 16) -> np.ndarray:
        """Whole candidates, however long; batches of like lengths, of at most `area` characters or one candidate."""
        out, order, a = np.zeros(len(windows)), sorted(range(len(windows)), key=lambda i: len(windows[i][0])), 0
        while a < len(order):
            b = a + 1
            while b < min(len(order), a + at_once) and (b + 1 - a) * len(windows[order[b]][0]) <= area:
                b += 1
            out[order[a:b]] = self.whole(*self.pad([windows[i] for i in order[a:b]], self.width))
            a = b
        return out

    def train(self, windows: list[Window], y: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.01, seed: int = 6, part: tuple[int, int] = (0, 1)) -> None:
        """Adam; batches hold both labels alike. `steps` at least, and as many as show every window. The rate falls to a tenth. part: which of how many parts of the steps to take."""
        rng, half = np.random.default_rng(seed), batch // 2
        ones, zeros = (rng.permutation(np.flatnonzero(y == k)) for k in (1, 0))
        steps = max(steps, ceil(max(len(ones), len(zeros)) / half))
        first, last = (steps * k // part[1] for k in (part[0], part[0] + 1))
        windows = [seen(w) for w in windows]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        dim = self.p["e"].shape[1]
        for at_all in range(first, last):
            t = at_all - first + 1
            rows = np.concatenate([own.take(np.arange(at_all * half, at_all * half + half), mode="wrap") for own in (ones, zeros)])
            x, inside = self.pad([windows[i] for i in rows], self.width)
            logit, (x, cols, act, mask, size, at, pooled) = self.forward(x, inside)
            d = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            g = {"o": pooled.T @ d, "b": np.array([d.sum()])}
            into = d[:, None] * self.p["o"]
            f = act.shape[2]
            d_act = mask * (into[:, None, f:] / size[:, :, None] if size.ndim == 3 else into[:, None, f:] / size[:, None])
            top = np.zeros_like(act)
            np.put_along_axis(top, at[:, None], into[:, None, :f], axis=1)
            d_act = (d_act + top * mask) * (act > 0)
            flat = d_act.reshape(-1, f)
            g["w"], g["c"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(axis=0)
            d_cols = (d_act @ self.p["w"].T).reshape(*d_act.shape[:2], self.width, dim + 1)[:, :, :, :dim]
            g["e"] = np.zeros_like(self.p["e"])
            n = act.shape[1]
            for j in range(self.width):
                np.add.at(g["e"], x[:, j : j + n], d_cols[:, :, j])
            for k, a in g.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                self.p[k] = self.p[k] - rate * 0.1 ** ((at_all + 1) / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, windows: list[Window], y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the largest threshold with this recall."""
        z = self.logits(windows)
        self.place(z, z, y, np.ones(len(z)), recall)

    def place(self, z: np.ndarray, lowest: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """calibrate() from n logits each, of mean z and least `lowest`."""
        x, w, ones, zeros = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0]), n[y == 1].sum(), n[y == 0].sum()
        goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (goal - p)))
            w = w + np.clip(step, -1, 1)
        self.scale, self.shift = float(w[0]), float(w[1])
        kept = 1 / (1 + np.exp(-np.clip(lowest[y == 1] * self.scale + self.shift, -30, 30)))
        order = np.argsort(kept)
        self.threshold = float(kept[order][np.searchsorted(np.cumsum(n[y == 1][order]), np.floor((ones - 1) * (1 - recall)), side="right")])

    def probability(self, windows: list[Window]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(windows) * self.scale + self.shift, -30, 30))) if windows else np.zeros(0)


CAND = "array<struct<start:int,end:int,label:int,raw:binary,a:int,b:int>>"


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, base, cand): a row per document."""
    kind = docs.schema[key].dataType.simpleString()

    def found(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                few = b.iloc[at : at + 512]
                base = [base_spans(t) if t else [] for t in few["text"]]
                cand = [candidates(t, s) if t else [] for t, s in zip(few["text"], base, strict=True)]
                yield pd.DataFrame({"id": few["id"], "base": [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in base], "cand": [[dict(zip(("start", "end", "label", "raw", "a", "b"), c, strict=True)) for c in x] for x in cand]})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(thrifty(found), f"id {kind}, base array<struct<start:int,kind:int,end:int>>, cand {CAND}")


def distinct_candidates(scanned: DataFrame) -> DataFrame:
    """(label, raw, a, b, h, odd): all distinct candidates (label 0: other runs, 1 + kind: findings), a hash of each, and which half its run belongs to; a written table."""
    each = scanned.select(F.explode("cand").alias("c")).select("c.label", "c.raw", "c.a", "c.b").distinct()
    last = F.substring(F.md5(F.expr("substring(raw, a + 1, b - a)")), 32, 1)
    return cut(each.withColumn("h", F.xxhash64("raw", "a", "b")).withColumn("odd", F.conv(last, 16, 10).cast("int") % 2 == 1), "candidates")


def labelled(some: pd.DataFrame) -> tuple[list[Window], np.ndarray]:
    """Candidates and, with label 0, all words beside findings."""
    some = some.sort_values(["label", "h", "a", "b"], kind="stable")
    windows = [(bytes(r), int(a), int(b)) for r, a, b in zip(some["raw"], some["a"], some["b"], strict=True)]
    plain = sorted({(raw, m.start(), m.end()) for (raw, a, b), y in zip(windows, some["label"], strict=True) if y for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{6,}", raw) if m.end() <= a or m.start() >= b})
    return windows + plain, np.concatenate([some["label"].to_numpy(int), np.zeros(len(plain), int)])


def half_of(windows: list[Window]) -> np.ndarray:
    return np.array([int(hashlib.md5(w[0][w[1] : w[2]]).hexdigest(), 16) % 2 for w in windows], bool)


def shown(windows: list[Window], y: np.ndarray, rows: np.ndarray, as_found: bool, rng: np.random.Generator) -> tuple[list[Window], np.ndarray]:
    """Negatives; positives as found, in other surroundings, and there in other alphabets; with labels. Empty without both."""
    others = [windows[i] for i in np.flatnonzero(rows & (y == 0))]
    found = [windows[i] for i in np.flatnonzero(rows & (y == 1))]
    if not others or not found:
        return [], np.zeros(0, int)
    away = [moved(w, others[rng.integers(len(others))]) for w in found]
    spelled = [respelled(w, rng) for w in away]
    all_of = [*others, *(found if as_found else []), *away, *spelled]
    return all_of, np.r_[np.zeros(len(others), int), np.ones(len(all_of) - len(others), int)]


def learn(windows: list[Window], kinds: np.ndarray, recall: float = 0.99, seed: int = 7) -> CharCnn | None:
    """Trained on one half and calibrated on the other; None if there are too few findings or nothing else. kinds: as labelled() gives them."""
    y, rng = (kinds > 0).astype(int), np.random.default_rng(seed)
    odd = half_of(windows)
    both = lambda rows: len(set(y[rows])) == 2
    train, held = (~odd, odd) if both(~odd) and both(odd) else (np.ones(len(y), bool),) * 2
    if y.sum() < 4 or not both(train):
        return None
    model = CharCnn()
    model.train(*shown(windows, y, train, True, rng))
    model.calibrate(*shown(windows, y, held, False, rng), recall)
    return model


def learn_dealt(each: DataFrame, shards: int, recall: float = 0.99, seed: int = 7) -> CharCnn | None:
    """learn() of more candidates than one task is to hold: the shards' copies are averaged after each round."""
    halves = {(r.odd, r.y) for r in each.select("odd", (F.col("label") > 0).alias("y")).distinct().collect()}
    split, model = len(halves) == 4, CharCnn()
    dealt = cut(each.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition(2 * shards, "shard"), "shards")

    def of(t: pd.DataFrame, odd: bool, as_found: bool) -> tuple[list[Window], np.ndarray]:
        windows, kinds = labelled(t)
        rows = half_of(windows) == odd if split else np.ones(len(windows), bool)
        return shown(windows, (kinds > 0).astype(int), rows, as_found, np.random.default_rng([seed, int(odd), int(t["shard"].iloc[0])]))

    def trained(k):
        def one(t):
            own, (windows, y) = CharCnn(), of(t, False, True)
            if not windows:
                return pd.DataFrame({"part": [], "shard": [], "p": []})
            own.p = dict(model.p)
            own.train(windows, y, part=(k, ROUNDS))
            return pd.DataFrame({"part": t["shard"].iloc[:1] % 16, "shard": t["shard"].iloc[:1], "p": [np.concatenate([v.ravel() for v in own.p.values()]).tobytes()]})

        return one

    def added(t):
        t = t.sort_values("shard")
        return pd.DataFrame({"part": t["part"].iloc[:1], "shard": [len(t)], "p": [np.sum([np.frombuffer(v) for v in t["p"]], axis=0).tobytes()]})

    kind = "part int, shard int, p binary"
    for k in range(ROUNDS):
        copies = dealt.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(trained(k), kind)
        sums = copies.groupBy("part").applyInPandas(added, kind).toPandas().sort_values("part")
        if not len(sums):
            drop(dealt)
            return None
        mean, at = np.sum([np.frombuffer(v) for v in sums["p"]], axis=0) / sums["shard"].sum(), 0
        for name, v in model.p.items():
            model.p[name], at = mean[at : at + v.size].reshape(v.shape), at + v.size

    def logits(t):
        windows, y = of(t, True, False)
        return pd.DataFrame({"y": y, "z": model.logits(windows)})

    found = dealt.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(logits, "y int, z double")
    bins = found.groupBy("y", F.floor(F.col("z") / BIN).alias("bin")).agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi")).toPandas().sort_values(["y", "bin"])
    drop(dealt)
    if bins["y"].nunique() < 2:
        return None
    model.place(((bins["lo"] + bins["hi"]) / 2).to_numpy(), bins["lo"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float), recall)
    return model


def left_out_recall(windows: list[Window], kinds: np.ndarray, kind: int, recall: float = 0.99) -> float:
    """Share of one kind's findings, in other surroundings, that a network finds which never saw that kind."""
    model, rng = learn([w for w, k in zip(windows, kinds, strict=True) if k != 1 + kind], kinds[kinds != 1 + kind], recall), np.random.default_rng(1)
    others, own = ([w for w, k in zip(windows, kinds, strict=True) if k == want] for want in (0, 1 + kind))
    away = [moved(w, others[rng.integers(len(others))]) for w in own if w[2] - w[1] >= LONG]
    return float((model.probability(away) >= model.threshold).mean()) if model and away else float("nan")


def fit(scanned: DataFrame, recall: float = 0.99, shard: int = SHARD) -> CharCnn | None:
    each = distinct_candidates(scanned)
    total, size = each.agg(F.count("*"), F.sum(F.length("raw"))).first()
    shards = ceil(max(total, (size or 0) / SEEN) / shard)
    model = learn(*labelled(each.toPandas()), recall) if shards <= 1 else learn_dealt(each, shards, recall)
    drop(each)
    return model


def _judged(scanned: DataFrame, model: CharCnn | None) -> DataFrame:
    """(id, spans) of what scan() made."""
    if model is None:
        return scanned.select("id", F.col("base").alias("spans"))

    @pandas_udf("array<double>")
    def probabilities(cands: pd.Series) -> pd.Series:
        flat = [(bytes(c["raw"]), c["a"], c["b"]) for cs in cands for c in cs]
        p, out, at = model.probability(flat), [], 0
        for cs in cands:
            out.append(p[at : at + len(cs)].tolist())
            at += len(cs)
        return pd.Series(out)

    others = F.filter("cand", lambda c: c["label"] == 0)
    judged = scanned.select("id", "base", others.alias("cand")).withColumn("p", probabilities(F.col("cand")))
    kept = F.filter(F.arrays_zip("cand", "p"), lambda c: c["p"] >= model.threshold)
    added = F.transform(kept, lambda c: F.struct(c["cand"]["start"].alias("start"), F.lit(3).alias("kind"), c["cand"]["end"].alias("end")))
    return judged.select("id", F.array_sort(F.concat("base", added)).alias("spans"))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = 0.99) -> DataFrame:
    """A row per document: key, spans array<struct<start, kind, end>> in order of start and kind, kind being a place in KINDS."""
    scanned = cut(scan(docs, key, text), "scanned")
    return _judged(scanned, fit(scanned, recall)).withColumnRenamed("id", key)


def as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of each base kind, the hash of the base findings, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redact(text: Column, model: CharCnn | None, mark: str = "[secret]") -> Column:
    """The text with every finding replaced; null stays null."""

    @pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base = base_spans(t) if t else []
            spans = [(s, e) for s, _, e in base]
            if t and model is not None:
                other = [c for c in candidates(t, base) if not c[2]]
                spans += [(c[0], c[1]) for c, p in zip(other, model.probability([c[3:] for c in other]), strict=True) if p >= model.threshold]
            if spans:
                parts, at = [], 0
                for s, e in sorted(spans):
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return redacted(text)


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = 0.99) -> DataFrame:
    """docs with all findings in their texts replaced: only texts of ids with findings are read a second time."""
    scanned = cut(scan(docs, key, text), "scanned")
    model = fit(scanned, recall)
    hit = cut(_judged(scanned, model).where(F.size("spans") > 0).select("id").distinct(), "hit")
    drop(scanned)
    hit = hit.withColumnRenamed("id", key)
    return may_hold(docs, hit, key, "left_anti").union(may_hold(docs, hit, key).withColumn(text, redact(F.col(text), model)))


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    return report(findings(table(spark, sf_dir, "documents")))
