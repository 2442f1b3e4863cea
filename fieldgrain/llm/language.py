"""Language ID by a bidirectional gated recurrent network over bytes (operator 6).

A text is read in windows of `window` bytes. In each a forward and a backward GRU label every byte position with
probabilities over the languages learnt; a document's probabilities are the mean over all positions of all its windows,
so the whole text counts, however long. Training is backpropagation through time in numpy, on a bounded sample of
windows of labelled documents outside the held-out fold. Windows of many documents are run through the network together,
a time step at a time. Only the text is an input of a prediction.

null text or text without a letter: `und`, score 0. Without labelled documents: `und`, score 0. Repeated rows are
labelled each; of rows that repeat an id one is learnt from, the same each time. Ties of probabilities: the language first
in the alphabet. Texts of any length are read whole, 512 texts at once. Further columns stay out of the result, whatever
their names. Empty table: no rows. A null doc_id is in no fold: predicted, not held out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, drop, fold, one_each, some_ids, table

WINDOW = 64


def softsign(a: np.ndarray) -> np.ndarray:
    """a / (1 + |a|), in place: tanh's shape at a tenth of its cost in numpy. Its slope is (1 - |softsign|)^2."""
    size = np.abs(a)
    size += 1
    a /= size
    return a


class ByteGru:
    """Per direction: input tables xg (256, 2h) and xn (256, h), recurrent ug (h, 2h) and un (h, h); output o (2h, labels), b. Gates: reset, update."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.p = {}
        for d in "fb":
            for k, width in (("g", 2 * hidden), ("n", hidden)):
                self.p["x" + k + d] = rng.normal(0, 0.5, (256, width))
                self.p["u" + k + d] = rng.normal(0, hidden**-0.5, (hidden, width))
        self.p["o"], self.p["b"] = rng.normal(0, 0.3, (2 * hidden, len(labels))), np.zeros(len(labels))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: bool):
        """Hidden states (time, batch, h) of bytes x (time, batch) in the direction's order; mask 0 holds the state at zero."""
        h, (steps, size) = self.h, x.shape
        xg, xn, ug, un = (self.p[k + d] for k in ("xg", "xn", "ug", "un"))
        states, saved = np.zeros((steps, size, h), xg.dtype), []
        now = np.zeros((size, h), xg.dtype)
        for t in range(steps):
            at = x[t].astype(np.intp)
            gates = np.take(xg, at, axis=0, mode="clip")
            gates += now @ ug
            softsign(gates)
            gates *= 0.5
            gates += 0.5
            new = np.take(xn, at, axis=0, mode="clip")
            new += (gates[:, :h] * now) @ un
            softsign(new)
            if keep:
                saved.append((now, gates, new))
            now = now - new
            now *= gates[:, h:]
            now += new
            if mask is not None:
                now *= mask[t][:, None]
            states[t] = now
        return states, saved

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(time, batch, labels) for bytes (time, batch)."""
        f, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x[::-1], None if mask is None else mask[::-1], "b", False)
        o = self.p["o"]
        e = f.reshape(-1, self.h) @ o[: self.h] + b[::-1].reshape(-1, self.h) @ o[self.h :] + self.p["b"]
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the positions, and its gradients by backpropagation through time."""
        h, (steps, size) = self.h, x.shape
        runs = {"f": self._run(x, mask, "f", True), "b": self._run(x[::-1], mask[::-1], "b", True)}
        both = np.concatenate([runs["f"][0], runs["b"][0][::-1]], axis=2)
        e = both @ self.p["o"] + self.p["b"]
        e -= e.max(axis=2, keepdims=True)
        e = np.exp(e)
        e /= e.sum(axis=2, keepdims=True)
        n = mask.sum()
        loss = -(np.log(e[:, np.arange(size), y] + 1e-9) * mask).sum() / n
        e[:, np.arange(size), y] -= 1
        e *= (mask / n)[:, :, None]
        g = {"o": np.einsum("tbh,tbl->hl", both, e), "b": e.sum(axis=(0, 1))}
        into = e @ self.p["o"].T
        for d, part in (("f", into[:, :, :h]), ("b", into[::-1, :, h:])):
            ug, un, xs, ms = self.p["ug" + d], self.p["un" + d], x if d == "f" else x[::-1], mask if d == "f" else mask[::-1]
            for k in ("xg", "xn", "ug", "un"):
                g[k + d] = np.zeros_like(self.p[k + d])
            later = np.zeros((size, h), e.dtype)
            for t in range(steps - 1, -1, -1):
                prev, gates, new = runs[d][1][t]
                r, z = gates[:, :h], gates[:, h:]
                dh = (part[t] + later) * ms[t][:, None]
                a_new = dh * (1 - z) * (1 - np.abs(new)) ** 2
                d_reset = a_new @ un.T
                a_gates = np.concatenate([d_reset * prev, dh * (prev - new)], axis=1) * 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
                np.add.at(g["xg" + d], xs[t], a_gates)
                np.add.at(g["xn" + d], xs[t], a_new)
                g["ug" + d] += prev.T @ a_gates
                g["un" + d] += (r * prev).T @ a_new
                later = dh * z + d_reset * r + a_gates @ ug.T
        return float(loss), g

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam on batches of windows; x, mask (windows, time). The rate falls to a tenth."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            rows = rng.integers(len(x), size=batch)
            loss, g = self.gradients(x[rows].T, mask[rows].T, y[rows])
            losses.append(loss)
            now = rate * 0.1 ** (t / steps)
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return losses

    def label(self, texts: list[str | None], window: int = WINDOW, at_once: int = 2048) -> np.ndarray:
        """(documents, labels): mean probabilities over all positions; zeros for empty texts."""
        raws = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        sizes = np.array([len(r) for r in raws])
        pieces = -(-sizes // window)
        out, doc = np.zeros((len(texts), len(self.labels))), np.repeat(np.arange(len(texts)), pieces)
        bytes_, first = np.zeros(int(pieces.sum()) * window, np.uint8), np.cumsum(pieces) - pieces
        for r, a in zip(raws, first, strict=True):
            bytes_[a * window : a * window + len(r)] = r
        bytes_ = bytes_.reshape(-1, window)
        filled = np.full(len(bytes_), window)
        last = (first + pieces - 1)[pieces > 0]
        filled[last] = (sizes - (pieces - 1) * window)[pieces > 0]
        # full windows need no mask
        for rows, full in ((np.flatnonzero(filled == window), True), (np.flatnonzero(filled < window), False)):
            for at in range(0, len(rows), at_once):
                own = rows[at : at + at_once]
                mask = None if full else (np.arange(window)[:, None] < filled[own]).astype(np.float32)
                e = self.probabilities(np.ascontiguousarray(bytes_[own].T), mask)
                total = e.sum(axis=0) if full else (e * mask[:, :, None]).sum(axis=0)
                np.add.at(out, doc[own], total)
        return out / np.maximum(1, sizes)[:, None]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 5, held: int = 0, most: int = 3000, windows: int = 4, window: int = WINDOW) -> ByteGru | None:
    """Learns from at most `windows` windows of each of at most `most` labelled documents outside the held-out fold."""
    known = docs.select(F.col(key).alias("id"), F.col(label).alias("y")).where((fold("id", folds) != held) & F.col("id").isNotNull() & F.col("y").isNotNull())
    sample = cut(some_ids(known, most, "id").select("id").distinct(), "sample")
    wanted = F.broadcast(sample)  # at most `most` ids
    kind = docs.schema[key].dataType.simpleString()

    def windows_of(batches):
        for b in batches:
            rows = []
            for i, t, y in zip(b["id"], b["text"], b["y"], strict=True):
                raw = (t or "").encode()
                if any(map(str.isalpha, t or "")):
                    n = -(-len(raw) // window)
                    rows += [(i, y, raw[w * window : (w + 1) * window]) for w in sorted({n * k // windows for k in range(windows)})]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "y", "raw"])

    rows = one_each(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("y")).where("y is not null").join(wanted, "id").select("id", "text", "y"))
    found = rows.mapInPandas(windows_of, f"id {kind}, y string, raw binary").toPandas()
    drop(sample)
    if not len(found):
        return None
    found = found.sort_values(["id", "raw"], kind="stable")
    labels = sorted(found["y"].unique())
    x, mask = np.zeros((len(found), window), np.uint8), np.zeros((len(found), window), np.float32)
    for i, r in enumerate(found["raw"]):
        x[i, : len(r)] = np.frombuffer(r, np.uint8)
        mask[i, : len(r)] = 1
    model = ByteGru(labels)
    model.train(x, mask, found["y"].map({y: i for i, y in enumerate(labels)}).to_numpy())
    return model


def predict(text: Column, model: ByteGru | None) -> Column:
    """struct(lang_pred, score)."""

    @pandas_udf("lang_pred string, score double")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        clean = [t if t and any(map(str.isalpha, t)) else None for t in texts]
        if model is None:
            return pd.DataFrame({"lang_pred": ["und"] * len(clean), "score": [0.0] * len(clean)})
        lang, score = [], []
        for at in range(0, len(clean), 512):
            few = clean[at : at + 512]
            p = model.label(few)
            best = p.argmax(axis=1)
            lang += [model.labels[i] if t else "und" for t, i in zip(few, best, strict=True)]
            score += [min(1.0, float(q[i])) if t else 0.0 for t, q, i in zip(few, p, best, strict=True)]
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return labelled(text)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = docs.select("doc_id", predict(F.col("text"), fit(docs)).alias("found"))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "found.lang_pred", "found.score")
