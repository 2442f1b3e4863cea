"""Relational operators on small tables with answers worked out by hand, and sources, sinks and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrain.functions import codecs, kernels
from fieldgrain.operators import markers, measure, positivity, scoring, segment
from fieldgrain.sources import images, writers
from fieldgrain.streaming import folder

from .test_kernels import disks


def values(spark, rows):
    return spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")


def test_mixture_finds_two_and_declines_one(spark):
    rng = np.random.default_rng(3)
    rows = [("two", v) for v in (*rng.normal(20, 6, 40), *rng.normal(120, 6, 15))] + [("one", v) for v in rng.normal(25, 6, 50)] + [("flat", 5.0)] * 4 + [("few", 1.0), ("few", 2.0)]
    got = {r.g: r for r in positivity.mixture_calls(values(spark, rows), "g", "v").collect()}
    assert got["two"].bimodal and got["two"].n_positive == 15 and 35 < got["two"].threshold < 110
    for g in ("one", "flat", "few"):
        assert not got[g].bimodal and got[g].n_positive == 0 and got[g].threshold == float("inf")
    report = {r.g: r.report for r in positivity.report(positivity.mixture_calls(values(spark, rows), "g", "v"), "mixture").collect()}
    assert "percent positive        : 27.27%" in report["two"] and "inf" in report["one"]


def test_exact_otsu_and_calls(spark):
    v = [*np.linspace(15.8, 28.1, 31), *np.linspace(104.6, 137.0, 13)]
    df = values(spark, [("a", x) for x in v] + [("same", 1.0)] * 5)
    t = markers.exact_otsu(df, "g", "v")
    got = {r.g: r.threshold for r in t.collect()}
    assert 28.1 < got["a"] < 104.6 and got["same"] == float("inf")
    called = markers.call(df.withColumnRenamed("v", "marker_mean"), t, "g")
    s = {r.g: r for r in markers.summarize(called, called, "g").collect()}
    assert s["a"].positive == 13 and s["a"].percent_positive == pytest.approx(1300 / 44) and s["same"].separation is None


def test_control(spark):
    df = values(spark, [("x", v) for v in range(100)])
    (r,) = positivity.control_call(df, "g", "v", df).collect()
    assert r.threshold == pytest.approx(98.01) and r.n_positive == 1
    with pytest.raises(Exception, match="no objects"):
        positivity.control_call(df, "g", "v", df.where("false")).collect()


def planes(spark, image, pred, true):
    y, x = np.mgrid[: pred.shape[0], : pred.shape[1]]
    rows = [(image, int(a), int(b), int(p), int(t)) for a, b, p, t in zip(y.ravel(), x.ravel(), pred.ravel(), true.ravel(), strict=True)]
    return spark.createDataFrame(rows, "image string, y int, x int, pred int, truth int")


def scored(px):
    pairs, counts = scoring.ious(px), scoring.object_counts(px)
    matches = scoring.matched(pairs)
    return {r.percent: (r.tp, r.fp, r.fn) for r in scoring.by_threshold(matches, counts).collect()}, scoring.split_merge(pairs, counts).first(), matches


def test_scores(spark):
    a, b = np.zeros((20, 30), int), np.zeros((20, 30), int)
    a[5:15, 5:15] = 1
    b[5:15, 10:20] = 1
    assert scoring.ious(planes(spark, "i", a, b)).first().iou == pytest.approx(50 / 150)
    by, wrong, _ = scored(planes(spark, "i", a, a))
    assert by[50] == by[95] == (1, 0, 0) and (wrong.split, wrong.merge) == (0, 0)
    by, _, _ = scored(planes(spark, "i", a * 0, b))
    assert by[50] == (0, 0, 1)
    cut, whole = np.zeros((30, 30), int), np.zeros((30, 30), int)
    cut[5:25, 5:15], cut[5:25, 15:25], whole[5:25, 5:25] = 1, 2, 1
    assert tuple(scored(planes(spark, "i", cut, whole))[1])[1:] == (1, 0)
    assert tuple(scored(planes(spark, "i", whole, cut))[1])[1:] == (0, 1)


def test_total_overlap_decides_before_the_threshold(spark):
    line = np.arange(198)[None]
    pred, true = np.where(line < 149, 1, 2), np.where(line >= 49, 1, 2)
    by, _, matches = scored(planes(spark, "i", pred, true))
    assert by[50] == (0, 2, 2) and matches.count() == 2


def test_ordinal_ranks(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in ((1, 0.0), (2, 0.0), (3, 1.0), (4, 5.0))] + [("b", 1, 1.0)], "g string, x int, y double")
    got = {r.g: r.rho for r in scoring.spearman(df, "g", "x", "y").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None


def test_summaries_keep_empty_images(spark):
    images_ = spark.createDataFrame([("a",), ("empty",)], "image string")
    objects = spark.createDataFrame([("a", 3.0, 1.0, float("nan"), True), ("a", 5.0, 2.0, 0.5, False)], "image string, area_pixels double, mean_intensity double, circularity double, touches_border boolean")
    got = {r.image: r for r in measure.summarize(images_, objects).collect()}
    assert got["a"]["count"] == 2 and got["a"].mean_circularity == 0.5 and got["empty"]["count"] == 0 and got["empty"].mean_area is None


def test_folder_to_objects_and_back(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "good.png").write_bytes(codecs.to_png(disks(100, [(30, 30), (70, 70)], 12)))
    (src / "bad.png").write_bytes(b"this is not an image")
    files = images.image_files(spark, str(src))
    found = {r.path.rsplit("/", 1)[1]: r for r in segment.analyze(files).collect()}
    assert found["good.png"].n_objects == 2 and found["good.png"].error is None
    assert found["bad.png"].n_objects is None and "not an image" in found["bad.png"].error
    big = segment.analyze(files, most_pixels=100).where("path like '%good.png'").first()
    assert "too many" in big.error
    q = folder.start(folder.watch(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    o = segment.objects(segment.analyze(files))
    writers.write_csv(o.select("object_id", "area_pixels"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    pngs = segment.analyze(files, planes=True).where("error is null").select(F.lit("mask.png").alias("name"), "mask_png")
    writers.write_files(pngs, str(tmp_path / "png"), "name", "mask_png")
    mask = codecs.read((tmp_path / "png" / "mask.png").read_bytes())[0] > 0
    assert kernels.components(mask).max() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "plate.txt").write_text("header\n" + "\n".join(str(i) for i in range(96)))
    p = {(r.well_row, r.well_col): r.dose for r in images.platemap(spark, str(tmp_path / "plate.txt")).collect()}
    assert len(p) == 96 and p["A", 1] == 0 and p["A", 12] == 11 and p["B", 1] == 12 and p["H", 12] == 95
    (tmp_path / "split.txt").write_text("a.tif\n\nfolder/b.png\n")
    assert sorted(r.stem for r in images.split_stems(spark, str(tmp_path / "split.txt")).collect()) == ["a", "b"]
    files = spark.createDataFrame([("f/b.tif",), ("f/a.TIF",), ("f/c.png",)], "path string")
    assert [r.stem for r in images.listed_stems(spark, str(tmp_path / "none.txt"), files).collect()] == ["a", "b"]
    assert sorted(r.stem for r in images.listed_stems(spark, str(tmp_path / "split.txt"), files).collect()) == ["a", "b"]
    (tmp_path / "truth.json").write_text('{"x.png": 3, "y.png": {"n": 1}}')
    assert {r.file: r.truth for r in images.truth_counts(spark, str(tmp_path / "truth.json")).collect()} == {"x.png": "3", "y.png": '{"n":1}'}
    wells = spark.createDataFrame([("f/Channel1-01-A-03.BMP", b"1"), ("f/Channel2-01-A-03.BMP", b"2"), ("f/other.BMP", b"3")], "path string, content binary")
    (r,) = images.well_channels(wells, images.platemap(spark, str(tmp_path / "plate.txt"))).collect()
    assert (r.well_row, r.well_col, r.dose, bytes(r.channel_1), bytes(r.channel_2)) == ("A", 3, 2.0, b"1", b"2")


def test_two_channels(spark):
    from fieldgrain.sources import synthetic

    rows = synthetic.rows(("marker_pair", "marker_none"))
    files = spark.createDataFrame([*((p, bytearray(c)) for p, c, *_ in rows), ("bad.png", bytearray(b"no"))], "path string, content binary")
    got = {r.path: r for r in segment.percent_positive(files).collect()}
    assert (got["marker_pair.png"].n_objects, got["marker_pair.png"].n_positive) == (44, 13)
    assert got["marker_none.png"].n_objects == 48 and not got["marker_none.png"].bimodal and got["marker_none.png"].n_positive == 0
    assert got["bad.png"].error and got["bad.png"].n_positive is None


def test_counts_of_generated_fields(spark):
    from fieldgrain.sources import synthetic

    files = spark.createDataFrame([(p, bytearray(c)) for p, c, *_ in synthetic.rows(("easy", "moderate", "difficult"))], "path string, content binary")
    n = {r.path: r.n_objects for r in segment.analyze(files, segment.SegmentParams(channel="blue")).collect()}
    assert n["easy.png"] == 32 and n["moderate.png"] == 34 and 0.4 * 110 <= n["difficult.png"] <= 0.9 * 110
    whole = {r.path: r.n_objects for r in segment.analyze(files, segment.SegmentParams(channel="blue", watershed=False)).collect()}
    assert whole["easy.png"] == 32 and whole["moderate.png"] <= 24  # touching objects merge without it


def test_touching_objects_touch():
    from fieldgrain.sources import synthetic

    _, at = synthetic.draw(synthetic.FIELDS["moderate"])
    apart = np.hypot(at[:, None, 0] - at[:, 0], at[:, None, 1] - at[:, 1]) / (at[:, None, 2] + at[:, 2])
    np.fill_diagonal(apart, 9)
    close = apart[apart < 1]
    assert len(close) // 2 >= 9 and 0.82 <= close.min() and close.max() <= 0.95


def test_marker_methods_by_name(spark):
    from fieldgrain.operators import markers
    from fieldgrain.sources import synthetic

    objects = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 1.2, 9.0, 9.1, 9.2)] + [("b", 5.0), ("b", 5.0)], "image string, marker_mean double")
    got = lambda *a, **k: {r.image: r.threshold for r in markers.choose_thresholds(objects, "image", "marker_mean", *a, **k).collect()}
    assert got("otsu") == {"a": pytest.approx(5.1), "b": float("inf")} and got("manual", manual=7) == {"a": 7.0, "b": 7.0} and got("mixture")["b"] == float("inf")
    with pytest.raises(ValueError, match="needs a value"):
        got("manual")
    with pytest.raises(ValueError, match="method must be"):
        got("median")
    tiny = objects.where("image = 'a'").withColumn("marker_mean", F.col("marker_mean") * 1e-6)
    assert markers.exact_otsu(tiny, "image", "marker_mean").head().threshold == pytest.approx(5.1e-6)
    files = spark.createDataFrame([(p, bytearray(c)) for p, c, *_ in synthetic.rows(("marker_pair",))], "path string, content binary")
    assert [segment.percent_positive(files, method=m, manual=v).head().n_positive for m, v in (("otsu", None), ("manual", 100), ("manual", 256))] == [13, 13, 0]


def test_registered_engine(spark):
    def halves(plane, p):
        labels = np.ones(plane.shape, np.int32)
        labels[:, plane.shape[1] // 2 :] = 2
        return segment.Segmentation(labels, None, "halves", False)

    with pytest.raises(ValueError, match="either"):
        segment.register_engine("both", halves, "no")
    plane = np.zeros((4, 6), np.float32)
    segment.register_engine("halves", halves)
    try:
        assert segment.engine_reason("halves") is None and segment.segment(plane, segment.SegmentParams(engine="halves")).n_objects == 2
    finally:
        del segment.ENGINES["halves"]
    assert "not installed" in segment.engine_reason("learned") and "unknown" in segment.engine_reason("halves")
    with pytest.raises(ValueError, match="not installed"):
        segment.segment(plane, segment.SegmentParams(engine="learned"))


def test_kernels_agree_with_relations(spark):
    """Thresholds, stretch and object measures by numpy and by DataFrame over the same planes."""
    from fieldgrain.functions import kernels
    from fieldgrain.operators import measure, planes

    rng = np.random.default_rng(2)
    stack = rng.random((6, 8, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(stack)], "vec_id long, embedding array<float>")
    px = planes.pixels(df, "vec_id", "embedding", 8)
    for f, g in ((planes.otsu, kernels.otsu), (planes.yen, kernels.yen), (planes.triangle, kernels.triangle)):
        assert {r.image: r.threshold for r in f(px).collect()} == {i: pytest.approx(g(p.astype(float)), abs=1e-9) for i, p in enumerate(stack)}
    by_kernel = [kernels.stretch(p) for p in stack]
    assert all(r.v == pytest.approx(float(by_kernel[r.image][r.y, r.x]), abs=1e-5) for r in planes.stretch(px).collect())
    labels = [kernels.components(p > 0.5) for p in stack]
    lab = spark.createDataFrame([(i, int(y), int(x), float(p[y, x]), int(n[y, x])) for i, (p, n) in enumerate(zip(stack, labels, strict=True)) for y, x in np.ndindex(8, 8)], "image int, y int, x int, v double, label int")
    got = {(r.image, r.object_id): r for r in measure.regions(lab).withColumn("touches_border", measure.touches_border(8, 8)).collect()}
    want = {(i, o[0]): dict(zip(segment.OBJECT_COLUMNS, o, strict=True)) for i, (p, n) in enumerate(zip(stack, labels, strict=True)) for o in segment.measure(n, p)}
    assert set(got) == set(want)
    for k, w in want.items():
        assert all(got[k][c] == pytest.approx(w[c], abs=1e-3) for c in ("centroid_x", "centroid_y", "area_pixels", "equivalent_diameter_pixels", "eccentricity", "major_axis_pixels", "minor_axis_pixels", "mean_intensity", "maximum_intensity", "minimum_intensity", "touches_border"))


def test_masks_pair_by_stem(spark):
    a = spark.createDataFrame([("x/one.tif", b"1"), ("x/two.png", b"2"), ("x/three.png", b"3")], "path string, content binary")
    b = spark.createDataFrame([("m/one.png", b"m1"), ("m/three.tiff", b"m3"), ("m/other.png", b"m4")], "path string, content binary")
    assert {(r.stem, bytes(r.content), bytes(r.mask)) for r in images.pair_with_masks(a, b).collect()} == {("one", b"1", b"m1"), ("three", b"3", b"m3")}


def test_overrides_and_report(spark):
    from fieldgrain.operators import positivity

    files = spark.createDataFrame([("a/public_immunohistochemistry.png",), ("b/x.png",)], "path string")
    got = {r.path: (r.channel, r.background, bool(r.caveat)) for r in images.with_overrides(files, images.samples(spark)).collect()}
    assert got == {"a/public_immunohistochemistry.png": ("blue", "light", True), "b/x.png": ("grayscale", "dark", False)}
    objects = spark.createDataFrame([("a", float(v)) for v in (1, 2, 1, 2, 1, 2, 90, 91, 92, 90)], "image string, v double")
    text = positivity.report(positivity.mixture_calls(objects, "image", "v"), "mixture", control="none", context={"stain": "green", "pixel size": 0.5}).head().report.split("\n")
    assert text[3:5] == ["stain".ljust(24) + ": green", "pixel size".ljust(24) + ": 0.5"] and text[-2] == "negative control".ljust(24) + ": none" and text[-1].startswith("note: two populations")
    assert any(x.startswith("positive component") for x in text)


def test_pictures():
    from fieldgrain.operators import render

    labels = np.zeros((20, 20), int)
    labels[3:8, 3:8], labels[10:16, 10:16] = 1, 2
    plane = labels.astype(np.float32) / 2
    assert render.display_rgb(np.array([[0, 50], [100, 200]], np.uint16))[..., 0].tolist() == [[0, 63], [127, 255]] and render.display_rgb(np.full((2, 2, 4), 7, np.uint8)).tolist() == [[[7] * 3] * 2] * 2
    assert render.display_rgb(plane).shape == (20, 20, 3) and render.mask_picture(labels).sum() == 255 * 61
    assert tuple(render.outlined(plane, labels)[2, 4]) == render.OUTLINE
    picture = render.marker_picture(plane, labels, [2])
    assert tuple(picture[9, 12]) == render.POSITIVE and tuple(picture[2, 4]) == render.NEGATIVE
    colours = render.label_colours(labels)
    assert (colours[0, 0] == 0).all() and (colours[4, 4] != colours[12, 12]).any()


def test_saved_outputs(spark, tmp_path):
    files = spark.createDataFrame([("f/one.png", bytearray(codecs.to_png(disks(100, [(30, 30), (70, 70)], 12)))), ("f/bad.png", bytearray(b"x"))], "path string, content binary")
    writers.save_outputs(segment.analyze(files, planes=True), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one_annotated.png", "one_mask.png", "one_measurements.csv"]
    lines = (tmp_path / "out" / "one_measurements.csv").read_text().split("\n")
    assert lines[0].startswith("object_id,centroid_x") and len(lines) == 3 and lines[1].split(",")[1] == "30.000"
    grid = segment.grid(watershed=[True, False])
    writers.save_outputs(segment.analyze(files, grid, planes=True), str(tmp_path / "grid"))
    assert sorted(p.name for p in (tmp_path / "grid").iterdir()) == sorted(f"one_watershed={w}_{k}" for w in (True, False) for k in ("annotated.png", "mask.png", "measurements.csv"))
    with pytest.raises(ValueError, match="would write files"):
        writers.save_outputs(segment.analyze(files.union(files), planes=True), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_saved_marker_outputs(spark, tmp_path):
    objects = spark.createDataFrame([("f/a.png", 1, 10.0, True), ("f/a.png", 2, 1.5, False), ("f/b.png", 1, 2.0, False)], "path string, object_id long, marker_mean double, marker_positive boolean")
    summary = spark.createDataFrame([("f/a.png", 2, 1, 50.0), ("f/b.png", 1, 0, float("inf"))], "path string, total long, positive long, percent_positive double")
    writers.save_marker_outputs(objects, summary, str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["a_markers.csv", "b_markers.csv", "marker_summary.csv"]
    assert (tmp_path / "m" / "a_markers.csv").read_text().split("\n") == ["object_id,marker_mean,marker_positive", "1,10.000,true", "2,1.500,false"]
    assert (tmp_path / "m" / "marker_summary.csv").read_text().split("\n")[1] == "1,f/a.png,2,1,50.000"
    assert {r.path: r.json for r in writers.report_json(summary, "path").collect()} == {"f/a.png": '{"total":2,"positive":1,"percent_positive":50.0}', "f/b.png": '{"total":1,"positive":0}'}
