"""Links, rules, components and the pipeline against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldgrain.llm import common, components, embedding_links, registry, url_filters

from ..conftest import DATA


def brute(edges):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(i, (i * 7 + 3) % 50) for i in range(40)] + [(5, 5), (None, 3), (4, None), (9, 8), (9, 8)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


# ---- 2: URLs


def page(i, url, link=None, refresh=None):
    html = "<html><head>" + (f'<LINK href="{link}" rel=canonical>' if link else "") + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else "") + "</head></html>"
    return (i, url, html, "x")


def test_small_tables_have_few_files(spark, monkeypatch):
    """However many tasks make a table, a small one is dealt out to few that write it, and a large one is not."""
    cores, written, real = spark.sparkContext.defaultParallelism, [], components.cut

    def counted(*args):
        out = real(*args)
        written.append((args[1], len(out.inputFiles())))
        return out

    monkeypatch.setattr(components, "cut", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(cores * common.FILE_TASKS))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        got = components.components(chain)
        assert [r.component for r in got.collect()] == [0] * 401
        assert [n for n, _ in written][0] == "edges" and len(written) > 3 and max(n for name, n in written if name != "edges") <= cores
        monkeypatch.setattr(common, "FILE_BYTES", 1)
        assert len(real(common.few_files(got.repartition(2 * cores), got), "stage").inputFiles()) == 2 * cores
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rules_and_aliases(spark):
    rows = [
        page(1, "http://Shop.COM/en/1?x=1"), page(2, "https://a.example.com/en/77"), page(3, "https://b.net/de/1"), page(4, "https://example.net/de/88#t"), page(5, "http://x.org/es/"), page(6, "http://notcom/en/1"), page(7, None), page(8, "no scheme"), page(9, "http://host"),
        page(10, "http://mirror.info/p", link="https://shop.com/en/1?x=1"), page(11, "http://hop.info/q", refresh="/r"), page(12, "http://hop.info/r", refresh="http://mirror.info/p"),
        page(13, "http://free.info/a", link="//shop.com/en/5"), page(14, "http://free.info/a", refresh="https://q.net/de/1"), page(10, "http://mirror.info/p"), (15, "http://lone.info/", None, "y"), page(16, "http://rel.info/d/e?z", link="f.html"),
        page(17, "http://rel.info/d/f.html", link="https://w.org/es/9"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got[1] == ("shop.com", "/en/1", "com/en/", "block") and got[2][2:] == ("example.com/en/7", "allow") and got[3][2:] == ("net/de/", "allow")
    assert got[4] == ("example.net", "/de/88", "example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6][2:] == (None, "allow") and got[7] == got[8] == ("", "", None, "allow") and got[9] == ("host", "", None, "allow")
    assert [got[i][3] for i in (10, 11, 12)] == ["block"] * 3  # aliases of a blocked page
    assert got[13][3] == got[14][3] == "allow"  # an allow rule in the component takes precedence
    assert got[16][3] == got[17][3] == "block"
    several = '<link rel="canonical"><link rel="canonical" href="#"><link rel=canonical href="http://w.org/es/1"><meta http-equiv=refresh content="0; url=http://hop.info/r">'
    more = url_filters.judge(spark.createDataFrame([*rows, (18, "http://many.info/", several, "z"), (19, "http://many.info/?q", "", "z")], df.schema)).collect()
    assert {r.page_id: r.verdict for r in more}[18] == "block" and {r.page_id: r.verdict for r in more}[19] == "allow"
    assert url_filters.judge(df.where("false")).count() == 0 and len(url_filters.judge(df).collect()) == len(rows)


def test_url_sql_agrees_on_aliases(spark):
    import duckdb

    rows = [page(i, f"http://h{i}.info/p", link=f"http://h{i + 1}.info/p") for i in range(5)] + [page(9, "http://h5.info/p", refresh="https://z.com/en/1"), page(10, "http://alone.info/"), (11, "http://two.info/", '<link rel=canonical href="#"><link rel=canonical href="/x"><link rel=canonical href="http://h2.info/p">', "x"), (12, "http://two.info/x", None, "x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR, v VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(registry.ORACLES["op2_url_filters"]).fetchall())
    df = spark.createDataFrame(rows, "page_id long, url string, html string, v string")
    got = sorted(tuple(r) for r in url_filters.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == want and sum(r[-1] == "block" for r in got) == 8


# ---- 9: embeddings


def check_links(spark, vectors, **how):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = {r.vec_id: r for r in embedding_links.link_vectors(df, **how).collect()}
    fine = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(vectors[i]) for i in fine), default=1)
    x = np.array([np.r_[vectors[i], np.zeros(width - len(vectors[i]))] for i in fine]).reshape(len(fine), width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(fine) else x
    met = (x @ x.T >= 0.95) & ~np.eye(len(fine), dtype=bool)
    roots = brute([(fine[a], fine[b]) for a, b in np.argwhere(met)])
    n = dict(zip(fine, met.sum(axis=1), strict=True))
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n.get(i, 0), roots.get(i, i), roots.get(i, i) == i)


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    near = [c + rng.normal(scale=s, size=16) for c in centres for s in (0.05, 0.15, 0.3) for _ in range(8)]
    crowd = [centres[0] * (1 + k % 3) + rng.normal(scale=0.04, size=16) for k in range(150)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None, 1.0], [float("inf"), 1.0], [1.0, 2.0], near[0], near[0] * 3]
    check_links(spark, [*near, *crowd, *rng.normal(size=(120, 16)), *odd], block=60)


def test_links_along_chains_and_at_one_point(spark):
    angles = np.arange(0, 3.0, 0.05)
    check_links(spark, [*np.stack([np.cos(angles), np.sin(angles)], axis=1), *[[1.0, 0.0]] * 20], block=16)


@pytest.mark.parametrize("noise", [1e-3, 1e-5, 1e-8, 1e-12])
def test_links_of_tight_clusters(spark, noise):
    """Copies that differ by numeric noise: single precision can't tell their cosines from 1."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 64))
    check_links(spark, [*(c + rng.normal(scale=noise, size=64) for c in centres for _ in range(50)), *rng.normal(size=(20, 64))])
    x = centres[0] + rng.normal(scale=noise, size=(50, 64))
    tree = embedding_links.Links(x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(50, int), 0.95).tree(np.arange(50))
    assert tree.weight == 50 and sorted(i for n in tree.children or [tree] for i in n.members) == list(range(50))


def clustered(n, seed=5, size=40, dims=16):
    """Clusters of `size` vectors, some of them within reach of each other, and one crowd of a fifth of all."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n * 4 // 5 // size), dims))
    near = np.repeat(base, size, axis=0) + rng.normal(scale=0.08, size=(len(base) * size, dims))
    return np.concatenate([near, base[0] + rng.normal(scale=0.04, size=(n - len(near), dims))])


def test_rows_dealt_out_grow_with_the_input(spark):
    """On clustered data, eight times the vectors: rows by a power of less than 1.2."""
    dealt = []
    for n in (2000, 16000):
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": clustered(n).tolist()}), "vec_id long, embedding array<double>")
        own = embedding_links.packed(df, "vec_id", "embedding")
        points = own.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        dealt.append(embedding_links.deal_out(own, points, 0.95, 250, 2000, 256).rows.count())
    assert dealt[1] / dealt[0] < 8**1.2


def test_links_in_crowded_blocks(spark):
    """A crowd and shells larger than a block, few cells: residents and visitors in several blocks."""
    check_links(spark, list(clustered(900, seed=6)), block=40, most_cells=3)
    check_links(spark, list(clustered(400, seed=7)), block=30, sample=50)


def test_no_vectors(spark):
    check_links(spark, [None, [0.0, 0.0]])
    assert embedding_links.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# ---- the pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage's output against a plain computation on its input."""
    import corpus_pipeline as p
    from fieldgrain.llm import common, decontaminate, secrets_scan
    docs, columns = common.table(spark, DATA, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    odd = spark.createDataFrame([(99001, None, None, None, None), (99002, "", "en", "s", 0)], docs.schema)
    docs = docs.union(odd).union(docs.limit(2))
    outs = []
    for name, step in p.STAGES:
        docs = common.cut(step(spark, docs, DATA), "test")
        outs.append(docs)
        assert name == p.STAGES[-1][0] or docs.columns == columns
    judged, single, pure, clean, packed = outs
    assert 0 < judged.count() <= 204
    texts = {r.doc_id: r.text for r in judged.collect()}  # repeated rows are equal here
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == stay(texts)
    items = [" ".join(decontaminate.words_of(r.text)) for r in common.table(spark, DATA, "benchmark").collect()]
    inside = lambda t: any(f" {i} " in f" {' '.join(decontaminate.words_of(t))} " for i in items)
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in pure.collect()}
    assert {i for i, t in before.items() if not inside(t)} >= set(after) and not any(inside(t) for t in after.values())
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert set(texts) == set(after) and not any(secrets_scan.base_spans(t or "") for t, _ in texts.values()) and all(n == len(t) for t, n in texts.values() if t is not None)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)
    again = p.run(spark, DATA)
    assert again.columns == packed.columns and again.count() > 0


def test_pipeline_on_no_rows(spark):
    import corpus_pipeline as p
    from fieldgrain.llm import common

    docs = common.table(spark, DATA, "documents").where("false")
    for _, step in p.STAGES:
        docs = common.cut(step(spark, docs, DATA), "test")
        assert docs.count() == 0


def stay(texts):
    """Ids that the second stage keeps: the least of each component of all pairs with equal or similar sets of five-word shingles (0.8)."""
    ids = sorted(texts)
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (texts[i] or "").lower().split()) else frozenset() for i in ids]
    roots = brute([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)])
    return [i for n, i in enumerate(ids) if roots.get(n, n) == n]


def test_dedup_step_and_repeated_ids(spark):
    """Rows of one id: copies go, texts unlike each other stay, each in its own group; rows without an id stay."""
    import corpus_pipeline as p
    from .conftest import frame, prose

    rng = np.random.default_rng(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, b), (3, c), (4, c + " x"), (4, a), (5, a), (None, a), (None, a), (6, None), (7, ""), (7, " ")]
    kept = p.dedup_step(spark, frame(spark, rows), DATA).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (3, c), (0, a), (0, a), (6, "")])
    assert p.dedup_step(spark, frame(spark, rows).where("false"), DATA).count() == 0


def test_shared_passages_make_no_pairs(spark):
    """Unlike documents that share a passage no sample ranks: their prefixes avoid it, and links stay those of all pairs."""
    from fieldgrain.llm import shingle_links
    from .conftest import frame, prose

    rng = np.random.default_rng(12)
    passage, texts = prose(rng, 50), []
    for k in range(60):
        own = prose(rng, 60)
        texts += [f"{own} {passage}", f"{passage} {own} more"] if k % 6 == 0 else [f"{own} {passage}"]
    texts += [passage, passage + " end", passage + " stop here"] + [f"{prose(rng, 4)} {passage}" for _ in range(12)]
    docs = frame(spark, list(enumerate(texts))).select("doc_id", "text")
    order = shingle_links.sampled_order(docs, "doc_id", "text", 5, 0)
    own = shingle_links.described(docs, "doc_id", "text", 5, 0.8, order).cache()
    pairs = lambda t: t.select(F.explode("prefix").alias("c")).groupBy("c").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).head()[0]
    better, _ = shingle_links.uncrowded(own.select("fp", "key", "n", "prefix", "rare"), docs, "doc_id", "text", 5, 0.8, order)
    assert better.count() == len(texts) and pairs(better) < pairs(own) / 10
    found = shingle_links.link(own, own.select("row"), docs, "doc_id", "text", 5, 0.8, order)
    root = {r.node: r.component for r in found.collect()}
    groups: dict = {}
    for r in own.select("key", "fp").collect():
        groups.setdefault(root.get(r.fp, r.fp), []).append(r.key)
    assert sorted(min(g) for g in groups.values()) == stay(dict(enumerate(texts)))


def test_prefixes_are_shuffled_once_where_made_anew_and_else_not(spark, monkeypatch):
    """A row a print comes back, from the document that stands for it, beside other texts and repeats under its id."""
    from fieldgrain.llm import shingle_links
    from .conftest import frame, prose

    rng, cut, plans, limit = np.random.default_rng(14), shingle_links.cut, [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    passage = prose(rng, 30)
    texts = [f"{prose(rng, 60)} {passage}" for _ in range(20)] + [prose(rng, 60) for _ in range(10)] + [None, ""]
    docs = frame(spark, [*enumerate(texts), (3, texts[3]), (3, texts[4] + " x"), (40, texts[5]), (None, texts[6])]).select("doc_id", "text")
    order = shingle_links.sampled_order(docs, "doc_id", "text", 5, 0)
    own = cut(shingle_links.described(docs, "doc_id", "text", 5, 0.8, order).where("key < 40").groupBy("fp").agg(F.min(F.struct("key", "n", "prefix", "rare")).alias("r")).select("fp", "r.*"), "own")
    shuffles = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(fp" in x]
    monkeypatch.setattr(shingle_links, "cut", lambda df, name: plans.append((name, len(shuffles(df)))) or cut(df, name))
    expected = own.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        better, _ = shingle_links.uncrowded(own, docs, "doc_id", "text", 5, 0.8, order)
        assert not shuffles(better)
        rows = better.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {n for name, n in plans if name == "moved"} == {1}  # the other side holds prints and keys only
    before = {r.fp: r for r in own.collect()}
    assert len(rows) == expected == len(before) and {(r.fp, r.key, r.n, len(r.prefix)) for r in rows} == {(r.fp, r.key, r.n, len(r.prefix)) for r in before.values()}
    assert any(list(r.prefix) != list(before[r.fp].prefix) for r in rows)


def test_edited_copies_meet_their_text(spark, monkeypatch):
    """Copies of a text with one edit each, too far from each other, link by the text; their pairs among each other are not made."""
    from fieldgrain.llm import shingle_links
    from .conftest import frame, prose

    rng = np.random.default_rng(13)
    base, made, verified = prose(rng, 60).split(), [], shingle_links._verified
    texts = [" ".join(base)]
    for k in range(150):
        words = list(base)
        words[5 + k % 50] = f"w{k}"
        texts.append(" ".join(words))
    texts += [f"{' '.join(base[:9])} {prose(rng, 12)}" for _ in range(30)]

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingle_links, "_verified", counted)
    docs = frame(spark, list(enumerate(texts))).select("doc_id", "text")
    order = shingle_links.sampled_order(docs, "doc_id", "text", 5, 0)
    own = shingle_links.described(docs, "doc_id", "text", 5, 0.8, order).cache()
    root = {r.node: r.component for r in shingle_links.link(own, own.select("row"), docs, "doc_id", "text", 5, 0.8, order).collect()}
    groups: dict = {}
    for r in own.select("key", "fp").collect():
        groups.setdefault(root.get(r.fp, r.fp), []).append(r.key)
    assert sorted(min(g) for g in groups.values()) == stay(dict(enumerate(texts)))
    assert made[-1] < 200 and sum(made) < 60 * len(texts), made


def test_dedup_step_by_brute_force(spark):
    """Chains of edited copies, crowded cells, a common line, short and empty texts: components of all pairs of similarity 0.8."""
    import corpus_pipeline as p
    from .conftest import frame, prose

    rng = np.random.default_rng(8)
    line, texts = prose(rng, 12), [None, "", "one", "ONE", "a b c", "a b c d e", "a b c d e f"]
    for n, copies in ((60, 40), (120, 10), (300, 6), (25, 8)):
        base = prose(rng, n).split()
        for k in range(copies):
            words = list(base)
            for at in rng.choice(n, int(n * rng.uniform(0, 0.04)), replace=False):
                words[at] = f"w{rng.integers(99)}"
            texts.append(" ".join(words) + f" {line}" * (k % 2))
    texts += [f"{prose(rng, 30)} {line}" for _ in range(30)]
    want = stay(dict(enumerate(texts)))
    kept = p.dedup_step(spark, frame(spark, list(enumerate(texts))), DATA)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want and len(want) < len(texts) - 30


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0 or name.startswith("op5_")


def test_pipeline_steps_hold_few_texts_at_once(spark):
    """No Python worker gets more than BATCH whole texts in one piece, whichever step runs first."""
    import corpus_pipeline

    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(10).cast("long").alias("n_chars")).coalesce(1)
    for _, step in corpus_pipeline.STAGES[2:4]:
        spark.conf.unset(name)
        try:
            step(spark, docs, "/root/testdata/sf0.001")
            sizes = docs.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int").collect()
        finally:
            spark.conf.unset(name)
        assert max(r.n for r in sizes) <= corpus_pipeline.BATCH


def test_workers_give_back_what_they_freed(spark):
    """What one function over batches has freed below memory in use is not held by its Python worker when the next one runs there."""

    def fill(batches):
        for b in batches:
            kept = [bytes(50_000) for _ in range(4000)]
            top = kept[-1]
            del kept
            yield b
        import builtins

        builtins.held_by_test = top

    def held(batches):
        for b in batches:
            text = open("/proc/self/smaps_rollup").read()
            yield pd.DataFrame({"mb": [int(text.split("Anonymous:")[1].split()[0]) / 1024]})

    rows = spark.range(1, numPartitions=1)
    before = rows.mapInPandas(held, "mb double").first().mb
    rows.mapInPandas(common.thrifty(fill), "id long").collect()
    assert rows.mapInPandas(held, "mb double").first().mb < before + 100
