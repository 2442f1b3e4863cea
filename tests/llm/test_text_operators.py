"""Operators on texts against brute force, libraries, and held-out labels."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldgrain.llm import common, components, decontaminate, language, packing, quality, secrets_scan, simhash, token_counts, toxicity

from .conftest import prose

TEXTS = st.text(st.sampled_from("ab cdé \n\t▁<|endoftx>'12.,  "), max_size=40)


# ---- 1: SimHash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) & (2**64 - 1) == slow_print(text)


def test_near_duplicates(spark, corpus):
    rows, df, _ = corpus
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {(r.doc_id, r.fingerprint) for r in got}
    assert prints == {(i, f"{slow_print(t):016x}") for i, t, *_ in rows}
    check_components(got)


def check_components(got):
    values = sorted({int(r.fingerprint, 16) for r in got})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for r in got:
        c = find(int(r.fingerprint, 16))
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(find(int(r.fingerprint, 16))) for r in got)


def test_links_leave_no_table_of_any_size_to_a_broadcast_by_estimate(spark, monkeypatch):
    plans, limit = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def seen(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.cut(df, name)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr(components, "cut", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        simhash.link(spark.createDataFrame([(v,) for v in (0, 1, 3, 7, 1 << 40, 5 << 40)], "fp long")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_links_of_crowded_fingerprints(spark):
    """Chains and balls of near fingerprints, whose pairs are not all within the distance."""
    rng = np.random.default_rng(2)
    values = {int(v) for v in rng.integers(0, 1 << 63, 60)}
    for c in list(values)[:6]:
        v = c
        for _ in range(60):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
            if rng.random() < 0.5:
                v = c
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.fp: r.root for r in simhash.link(df).collect()}

    class Row:
        def __init__(self, v, c):
            self.doc_id, self.fingerprint, self.component_id = v, f"{v & (2**64 - 1):016x}", c

    least = {}
    for (v,) in signed:
        k = roots.get(v, v)
        least[k] = min(least.get(k, v), v)
    check_components([Row(v, least[roots.get(v, v)]) for (v,) in signed])


# ---- 4: packing


@settings(max_examples=200, deadline=None)
@given(TEXTS)
@example("a<|endoftext|>b <|endoftext|>")
@example("one  two\n\n three \u00a0\u3000 x\x00 y  ")
@example("It's 12,345.67 naïve — “quotes” 日本語 😀")
@example("it's we'll 'til o'clock wait... (so)) \n end.\n Über, \t a \n\n b! ")
def test_ids_are_the_library_s(text):
    from tokenizers import Tokenizer

    path = common.locate("byte_bpe_50k.json")
    test_ids_are_the_library_s.library = getattr(test_ids_are_the_library_s, "library", None) or Tokenizer.from_file(path)
    for most in (1000, 4):
        assert np.frombuffer(packing._encoder(path, most).encode(text), "<u4").tolist() == test_ids_are_the_library_s.library.encode(text, add_special_tokens=False).ids


def check_plan(hist, capacity):
    used = np.zeros_like(hist)
    for pattern, times in (plan := packing.plan_sequences(hist, capacity)):
        assert sum(pattern) <= capacity and times > 0
        np.add.at(used, list(pattern), times)
    assert (used == hist).all()
    return sum(t for _, t in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plans_use_each_piece_once(sizes):
    n = check_plan(np.bincount(sizes, minlength=33).astype(np.int64), 32)
    assert n <= len(sizes) and n * 32 >= sum(sizes)


def test_plans_are_near_the_lower_bound():
    hist = np.random.default_rng(0).multinomial(50_000, np.r_[0, np.ones(1024) / 1024])
    assert check_plan(hist.astype(np.int64), 1024) <= 1.01 * -(-(hist * np.arange(1025)).sum() // 1024)


def test_packing(spark, corpus):
    """Every piece of every document against the library's ids; every sequence without gaps."""
    from tokenizers import Tokenizer

    rows, df, _ = corpus
    got = packing.pack(df, remembered=50).toPandas()
    library = Tokenizer.from_file(common.locate("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ends = list(range(len(ids), 0, -1024))[::-1]
        want += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    order = lambda r: tuple(-1 if v is None or v != v else int(v) for v in r)
    assert sorted(map(order, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(order, want))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024


def test_packing_of_other_keys(spark):
    """A text key, a clashing column, ties of length and repeated rows."""
    df = spark.createDataFrame([("a", "x y", 1), ("a", "x y", 2), (None, "x  y", 3), ("b", "", 4)], "name string, body string, length int")
    got = packing.pack(df, "name", "body").collect()
    assert sorted((r.name or "", r.piece, r.start) for r in got) == [("", 0, 0), ("a", 0, 0), ("a", 0, 0), ("b", 0, 0)] and len({(r.sequence_id, r.offset) for r in got}) == 4


# ---- 10: token counts


@settings(max_examples=200, deadline=None)
@given(TEXTS)
@example("<s> a </s><unk> b  ")
@example("日本語 😀 \x00 é e\u0301 ﬁ Ａ\t\r\n")
def test_counts_are_the_library_s(text):
    import sentencepiece

    path = common.locate("piece_bpe_32k.model")
    test_counts_are_the_library_s.library = getattr(test_counts_are_the_library_s, "library", None) or sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts._counts(path, 100_000).of(text) == len(test_counts_are_the_library_s.library.encode(text))


def test_whole_tokens_are_proven():
    c = token_counts._counts(common.locate("piece_bpe_32k.model"), 100_000)
    assert len(c.whole) > 5000 and all(len(c.model.encode(w)) == 1 for w in list(c.whole)[:500])


def test_token_counts(spark, corpus):
    rows, df, _ = corpus
    got = token_counts.count_tokens(df).collect()
    assert sorted((r.n_bytes for r in got)) == sorted(len((t or "").encode()) for _, t, *_ in rows)
    assert {r.over_limit for r in got if r.doc_id == 1004} == {True} and {r.n_tokens for r in got if r.doc_id in (1000, 1001)} == {0}


# ---- 5: decontamination


def test_distance_of_stretches():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, window = rng.integers(1, 5, rng.integers(1, 7)), rng.integers(0, 5, rng.integers(0, 12))
        best = min(slow_edit(item, window[a:b]) for a in range(len(window) + 1) for b in range(a, len(window) + 1))
        cost, a, b = decontaminate.stretch_distance(item, window)
        assert cost == best == slow_edit(item, window[a:b])


@pytest.mark.parametrize("n", [5, 9, 12, 13, 15, 16, 18, 20, 24])
def test_short_items_edited_evenly(n):
    """Beside many long items, which dominate a share pooled over all."""
    rng = np.random.default_rng(n)
    items = [prose(rng, n) for _ in range(8)] + [prose(rng, 60) for _ in range(30)]
    index = decontaminate.LeakIndex(list(range(len(items))), items)
    docs, many = [], int(0.2 * n + 1e-9)
    for t in range(160):
        words, step = items[t % 8].split(), n / many
        places = {int(step * (j + rng.random() * 0.99)) for j in range(many)} if t % 2 else set(rng.choice(n, many, replace=False).tolist())
        assert len(places) == many
        docs.append([*prose(rng, 20).split(), *(f"odd{t}x{at}" if at in places else w for at, w in enumerate(words)), *prose(rng, 20).split()])
    found = {(d, i) for d, i, *_ in index.scan(docs, decontaminate.Vocabulary(index.words))}
    assert sum((t, t % 8) in found for t in range(160)) >= 0.95 * 160


def slow_edit(x, y):
    d = np.arange(len(y) + 1)
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(min(d[j] + (a != b), d[j + 1] + 1, new[j] + 1))
        d = np.array(new)
    return int(d[-1])


def test_leaks(spark, corpus, empty):
    rng = np.random.default_rng(5)
    items = [(k, prose(rng, n)) for k, n in enumerate((30, 45, 16, 60, 7, 3))] + [(90, None), (91, ""), (92, "...")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs, want = [], set()
    for n in range(120):
        text = prose(rng, 80).split()
        k, (_, item) = n % 6, items[n % 6]
        if n % 2 == 0:
            words = item.split()
            for _ in range(int(0.2 * len(words) + 1e-9) * (n % 4 // 2)):
                words[int(rng.integers(len(words)))] = f"odd{rng.integers(99)}"
            text[30:30] = [w.upper() if n % 3 == 0 else w + "," for w in words]
            want.add((n, k))
        docs.append((n, " ".join(text)))
    docs += [(500, None), (501, ""), (502, items[4][1])]
    from .conftest import frame

    got = decontaminate.find_leaks(frame(spark, docs), table).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert (502, 4) in found and len(want - found) <= 0.05 * len(want)
    long = {(d, k) for d, k in found if k < 4}
    assert long <= want  # items of a few words may occur by chance
    assert all(r.similarity >= 0.8 for r in got)
    small = decontaminate.find_leaks(frame(spark, docs), table, block_words=60).select("doc_id", "item_id").collect()
    assert len({(r.doc_id, r.item_id) for r in small} & want) >= 0.95 * len(want)
    assert decontaminate.find_leaks(empty, table).count() == 0 and decontaminate.find_leaks(frame(spark, docs), table.where("false")).count() == 0


# ---- 3, 8: classifiers


def share_right(rows, key, known, cut=0.3):
    right = [(r.score >= cut) == bool(known[r.doc_id]) for r in rows if r.doc_id in known and r.held_out]
    assert len(right) > 20
    return np.mean(right)


@pytest.mark.parametrize(("operator", "column", "folds", "held"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifier(spark, corpus, empty, operator, column, folds, held):
    rows, df, labels = corpus
    got = operator.rate(df, labels).withColumn("held_out", common.fold("doc_id", folds) == held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert share_right(got, column, {r.doc_id: r[column] for r in labels.collect()}) > 0.93
    assert {r.score for r in operator.rate(df, labels.where("false")).collect()} <= {0.0, 1.0}
    assert operator.rate(empty, labels).count() == 0


# ---- 6: language


def test_gradients_by_finite_differences():
    m = language.ByteGru(["a", "b"], 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, mask, y = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.ones((6, 4)), np.array([0, 1, 1, 0])
    mask[4:, 1] = 0
    _, g = m.gradients(x, mask, y)
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, step, pair = m.p[k][i], 1e-4, []
        for s in (step, -step):
            m.p[k][i] = old + s
            pair.append(m.gradients(x, mask, y)[0])
        m.p[k][i] = old
        assert g[k][i] == pytest.approx((pair[0] - pair[1]) / 2 / step, rel=1e-2, abs=1e-6)


def test_language(spark, corpus, empty):
    rows, df, _ = corpus
    model = language.fit(df)
    got = {(r.doc_id, r.lang_pred, r.score) for r in df.select("doc_id", language.predict(df.text, model).alias("f")).select("doc_id", "f.*").collect()}
    lang = {r[0]: r[2] for r in rows[:240]}
    right = [p == lang[i] for i, p, _ in got if i in lang and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.95 and {p for i, p, _ in got if i in (1000, 1001, 1003)} == {"und"}
    assert language.fit(empty) is None
    assert {r.f.lang_pred for r in df.select(language.predict(df.text, None).alias("f")).collect()} == {"und"}
    whole = model.label(["der die das " * 400 + "and the of " * 1200])[0]
    assert model.labels[int(whole.argmax())] == "en" and whole.sum() == pytest.approx(1, abs=1e-3)


def test_batches_of_windows_are_a_plain_loop():
    """label() against a GRU that reads each window byte by byte, a text at a time."""
    rng = np.random.default_rng(1)
    m = language.ByteGru(["a", "b", "c"], 4)
    squash = lambda a: a / (1 + np.abs(a))

    def states(raw, d):
        h, out = np.zeros(m.h), []
        for c in raw:
            gates = 0.5 + 0.5 * squash(m.p["xg" + d][c] + h @ m.p["ug" + d])
            new = squash(m.p["xn" + d][c] + (gates[: m.h] * h) @ m.p["un" + d])
            h = gates[m.h :] * h + (1 - gates[m.h :]) * new
            out.append(h)
        return out

    def slow(text):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), 64):
            w = raw[at : at + 64]
            for f, b in zip(states(w, "f"), states(w[::-1], "b")[::-1], strict=True):
                e = np.exp(np.concatenate([f, b]) @ m.p["o"] + m.p["b"])
                total += e / e.sum()
        return total / max(1, len(raw))

    texts = [prose(rng, 40), "", "é", "x" * 64, "y" * 65, prose(rng, 200, "de")]
    assert np.allclose(m.label(texts), [slow(t) for t in texts], atol=1e-4)


def test_ranker_against_plain_gradient():
    """The fitted weights are where the pairwise loss, written out, has no slope; scores order what it was taught."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3)), np.zeros(300, int)
    x[:, 0] = np.abs(x[:, 0]) + 2
    y[x[:, 1] - 0.5 * x[:, 2] + rng.normal(scale=0.5, size=300) > 0] = 1
    m = quality.PairwiseRanker(x, y, 0.3, pairs=300, l2=1e-2, seed=5)
    z, draw = quality.expand(x, m.middle, m.spread), np.random.default_rng(5)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[draw.choice(good, 300)] - z[draw.choice(bad, 300)]

    def loss(w):
        return sum(np.log1p(np.exp(-(row @ w))) for row in d) / len(d) + 0.5 * 1e-2 * (w @ w)

    slope = [(loss(m.w + e) - loss(m.w - e)) / 2e-4 for e in np.eye(len(m.w)) * 1e-4]
    assert np.abs(slope).max() < 1e-4
    s = m.score(x)
    assert np.mean([s[a] > s[b] for a in good[:60] for b in bad[:60]]) > 0.9


def test_positive_unlabelled_risk_by_finite_differences(monkeypatch):
    """One step of the fit goes against the slope of the risk as the method defines it, on either side of zero."""
    rows, confirmed = [[0], [0, 1], [0, 0, 1], [1], [], [1, 1], [0], []], np.array([True, True, True] + [False] * 5)
    x = np.array([[min(r.count(i), toxicity.MOST) for i in range(2)] for r in rows], float)

    def risk(w, b, prior):
        p, u = (1 / (1 + np.exp(-(x[own] @ w + b))) for own in (confirmed, ~confirmed))
        clean = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
        return (prior * -np.log(p).mean() + clean) if clean >= 0 else -clean

    for prior in (0.1, 0.49):
        b0 = np.log(prior / (1 - prior))
        slope = [(risk(np.array(e[:2]), b0 + e[2], prior) - risk(-np.array(e[:2]), b0 - e[2], prior)) / 2e-5 for e in np.eye(3) * 1e-5]
        m = toxicity.NonNegativePU(rows, confirmed, 2, prior, steps=1, rate=1e-3, l2=0)
        moved = np.array([*m.w, m.b - b0])
        for got, g in zip(moved, slope, strict=True):
            assert abs(g) < 1e-7 or abs(got) < 1e-9 or np.sign(got) == -np.sign(g)
        assert moved[2] != 0 and all(w >= 0 for w in m.w)


# ---- 7: secrets


def slow_base(text):
    kinds = [r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    found = []
    for k, p in enumerate(kinds):
        for m in re.compile(p, re.ASCII).finditer(text):
            if (len(m[2]) >= 6, len(m[0]) >= 20, len(m[0]) >= 24)[k] if k == 0 else len(m[0]) >= (0, 20, 24)[k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "=", ": ", '"', "AKIA", "ABCDEFGHIJ0123456789", "abc", "0123456789abcdef", " ", "é", "key"]), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets_scan.base_spans(text) == slow_base(text)


def test_secrets(spark, corpus, empty):
    rows, df, _ = corpus
    got = secrets_scan.report(secrets_scan.findings(df)).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        base = slow_base(texts[r.doc_id])
        spelled = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert set(filter(None, spelled.split(","))) <= set(r.spans.split(","))
    clean = {r.doc_id: r.text for r in secrets_scan.redact_documents(df).collect()}
    assert all("password=" not in (t or "") for t in clean.values()) and clean[1000] is None and clean[1002] == "word"
    assert any("[secret]" in (t or "") for t in clean.values())
    assert secrets_scan.findings(empty).count() == 0


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(8)
    make = lambda chars, n: "".join(rng.choice(list(chars), n)).encode()
    windows = [(b"key is " + make("0123456789abcdef", 24) + b" here", 7, 31) for _ in range(60)] + [(b"word is " + make("aeiourstln", 20) + b" here", 8, 28) for _ in range(60)]
    y = np.r_[np.ones(60, int), np.zeros(60, int)]
    m = secrets_scan.CharCnn()
    m.train(windows[::2], y[::2])
    m.calibrate(windows[1::2], y[1::2], 0.99)
    p = m.probability(windows)
    assert (p[y == 1] >= m.threshold).mean() > 0.95 and (p[y == 0] >= m.threshold).mean() < 0.05
    long = [(make("0123456789abcdef", 5000), 0, 5000)]
    assert m.probability(long)[0] > 0.5
    some = windows[:7] + long + [(b"short", 0, 5)]
    assert np.allclose([m.forward(*m.pad([w], 5))[0][0] for w in some], m.logits(some)) and np.allclose(m.whole(*m.pad(long, 5), slice_=7), m.logits(long))


def findings_of_three_kinds(rng, n=150):
    """Windows and kinds as labelled() gives them: values of all base kinds beside keywords, and plain runs."""
    make = lambda chars, k: "".join(rng.choice(list(chars), k))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    texts = [f"{prose(rng, 3)} {key}{make(letters.upper() + letters + digits, int(rng.integers(16, 40)))} {prose(rng, 3)}" for key in ("password=", 'api_key: "') for _ in range(n)]
    texts += [f"{prose(rng, 4)} AKIA{make(letters.upper() + digits, 16)} {prose(rng, 3)}" for _ in range(n)]
    texts += [f"{prose(rng, 4)} {make('abcdef' + digits, int(rng.choice([24, 32, 40])))} {prose(rng, 3)}" for _ in range(n)]
    texts += ["".join(rng.choice("the of and to in is that for with was".split(), 6)) + f" mail{rng.integers(9)}.example.com {prose(rng, 2, 'de').replace(' ', '-')}-{prose(rng, 2, 'fr').replace(' ', '_')}" for _ in range(3 * n)]
    found = sorted({c[3:] + (c[2],) for t in texts for c in secrets_scan.candidates(t, secrets_scan.base_spans(t))})
    return [w[:3] for w in found], np.array([w[3] for w in found])


def test_a_kind_never_seen_is_found():
    """Network trained without one kind of finding: its recall on that kind, in surroundings without a keyword."""
    windows, kinds = findings_of_three_kinds(np.random.default_rng(3))
    recalls = [secrets_scan.left_out_recall(windows, kinds, k) for k in range(3)]
    assert min(recalls) >= 0.85, recalls
    model = secrets_scan.learn(windows, kinds)
    plain = [w for w, k in zip(windows, kinds, strict=True) if k == 0]
    assert (model.probability(plain) >= model.threshold).mean() < 0.03


def test_candidates_are_linear_and_whole():
    text = " ".join(f"token={i:06d} {i:032x} plainwordplainword{i} x" for i in range(4000))
    base = secrets_scan.base_spans(text)
    got = secrets_scan.candidates(text, base)
    runs = [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text) if not any(s < m.end() and m.start() < e for s, _, e in base[max(0, 3 * m.start() // 80 - 50) :])]
    assert len(got) == len(base) + 4000 and all(text[a:b] == f"plainwordplainword{i}" for i, (a, b, label, *_) in enumerate(g for g in got if not g[2])) and runs
    assert [text_[a:b] for text_ in ["ab12cd34 1234567 abcdefgh 2024-01-01"] for a, b, *_ in secrets_scan.candidates(text_, [])] == ["ab12cd34"]


def test_random_token_without_keyword_is_added(spark):
    """Spans of kind cnn in a corpus whose base findings are hex; a token of five million characters is read whole."""
    from .conftest import frame

    rng = np.random.default_rng(6)
    make = lambda chars, k: "".join(rng.choice(list(chars), k))
    rows = [(i, f"{prose(rng, 30)} secret={make('0123456789abcdef', 32)} {prose(rng, 30)}") for i in range(120)]
    rows += [(200 + i, prose(rng, 60) + f" mail{i}.example.com " + prose(rng, 3, "de").replace(" ", "")) for i in range(60)]
    token = make("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 36)
    rows += [(900, f"the {token} of"), (901, make("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123", 5_000_000)), (902, prose(rng, 10)), (None, f"{prose(rng, 5)} password=abcdef123")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in secrets_scan.report(secrets_scan.findings(df)).collect()}
    assert got[900].spans == "cnn:4:40" and got[900].base_sha256 == hashlib.sha256(b"").hexdigest() and got[901].spans == "cnn:0:5000000" and got[902].spans == ""
    assert sum("cnn" in got[200 + i].spans for i in range(60)) <= 3
    clean = {r.doc_id: r.text for r in secrets_scan.redact_documents(df).collect()}
    assert clean[900] == "the [secret] of" and clean[901] == "[secret]" and clean[902] == dict(rows)[902] and clean[None].endswith(" [secret]") and len(clean) == len(rows)


@pytest.mark.parametrize("run", [lambda e: simhash.near_duplicates(e), lambda e: simhash.near_duplicates(e, words=5, similarity=0.8), lambda e: packing.pack(e), lambda e: token_counts.count_tokens(e)])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_labels_that_conflict_or_repeat(spark, corpus):
    """Repeated ids with other texts and conflicting labels: the same scores each time."""
    rows, df, labels = corpus
    more = df.union(df.where("doc_id < 40").withColumn("text", F.lit("### other text |||")))
    conflicting = labels.union(labels.where("doc_id < 20").withColumn("quality", 1 - F.col("quality")))
    runs = [sorted((r.doc_id or -1, r.score) for r in quality.rate(d.repartition(n), conflicting).select("doc_id", "score").collect()) for d, n in ((more, 2), (more, 5))]
    assert [k for k, _ in runs[0]] == [k for k, _ in runs[1]] and np.allclose([v for _, v in runs[0]], [v for _, v in runs[1]])
    short = {r.text: r.score for r in quality.rate(spark.createDataFrame([(i, t) for i, t in enumerate(["###", "word", "", None])], "doc_id long, text string").union(df.select("doc_id", "text")), labels).select("text", "score").collect()}
    assert short["###"] < 0.3 and short["###"] < short["word"] and short[""] == short[None]


def test_tables_are_dropped(spark, corpus):
    """Of what a run writes only what its lazy result reads is left, and sweep() takes that."""
    rows, df, _ = corpus
    common.sweep(spark)
    simhash.near_duplicates(df).count()
    assert common.sweep(spark) <= 4 and common.sweep(spark) == 0


def test_quality_is_learnt_from_all_pairs(spark, corpus):
    """The loss over every pair of the labelled rows, written out by brute force, has no slope at the fitted weights, however tasks are dealt."""
    rows, df, labels = corpus
    known = {r.doc_id: r.quality for r in labels.where(common.fold("doc_id", 5) != 0).collect()}
    models = [quality.fit(df.repartition(n), labels) for n in (2, 7)]
    assert all(np.array_equal(getattr(models[0], k), getattr(models[1], k)) for k in ("w", "middle", "spread", "cut", "scale"))
    m, slopes = models[0], []
    for part in (False, True):
        own = {y: [t for i, text, *_ in rows if known.get(i) == y for t in (quality.excerpts(text) if part else [text])] for y in (0, 1)}
        good, bad = (quality.expand(np.array([quality.features_of(t) for t in own[y]]), m.middle, m.spread) for y in (1, 0))
        p = 1 / (1 + np.exp((good @ m.w)[:, None] - bad @ m.w))
        slopes.append((p.sum(axis=1) @ good - p.sum(axis=0) @ bad) / p.size)
    assert np.abs(np.mean(slopes, axis=0) - 1e-3 * m.w).max() < 2e-4


def test_secrets_are_learnt_from_every_candidate(spark, monkeypatch):
    """More findings of a kind than the 3 000 of old all reach training and calibration, in one piece or dealt into shards, which find the same."""
    from .conftest import frame

    rng = np.random.default_rng(9)
    make = lambda chars, k: "".join(rng.choice(list(chars), k))
    rows = [(i, " ".join(f"{prose(rng, 2)} {make('0123456789abcdef', 24)} {prose(rng, 2)} mail{i}x{k}.example.com" for k in range(40))) for i in range(85)]
    rows.append((900, f"the {make('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 36)} of"))
    scanned = common.cut(secrets_scan.scan(frame(spark, rows), "doc_id", "text"))
    seen, learn = [], secrets_scan.learn
    monkeypatch.setattr(secrets_scan, "learn", lambda w, k, r: seen.append(k) or learn(w, k, r))
    whole = secrets_scan.fit(scanned)
    assert (seen[0] == 3).sum() == 3400 and (seen[0] == 0).sum() >= 3401
    dealt = secrets_scan.fit(scanned, shard=2000)
    assert len(seen) == 1
    for model in (whole, dealt):
        got = {r.id: [s.kind for s in r.spans] for r in secrets_scan._judged(scanned, model).collect()}
        assert got[900] == [3] and sum(k == 3 for i in range(85) for k in got[i]) < 0.03 * 3400
    common.drop(scanned)
