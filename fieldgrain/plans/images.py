"""Queries over planes: intensity, thresholds, masks, labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import measure, planes, scoring, segment
from ..sources import images as sources
from .catalog import PX, patches, query, quadrant, quadrant_sql, table

R = lambda c, n=6: F.round(c, n).alias(c)
SPAN = "span AS (SELECT image, min(v) AS lo, max(v) AS hi FROM px GROUP BY image)"
UNIT = "unit AS (SELECT px.image, y, x, CASE WHEN lo >= 0 AND hi <= 1 THEN v WHEN hi <= lo THEN 0 ELSE (v - lo) / (hi - lo) END AS v FROM px JOIN span USING (image))"


@query(f"WITH {PX}, {SPAN}, {UNIT} SELECT image, y, x, round(v, 6) AS v FROM unit")
def to_float_rescale(spark, sf_dir):
    return planes.rescale(patches(spark, sf_dir)).select("image", "y", "x", R("v"))


@query(f"WITH {PX}, p AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM px GROUP BY image) SELECT image, y, x, round(CASE WHEN hi <= lo THEN 0 ELSE greatest(0, least(1, (v - lo) / (hi - lo))) END, 6) AS v FROM px JOIN p USING (image)")
def contrast_stretch(spark, sf_dir):
    return planes.stretch(patches(spark, sf_dir)).select("image", "y", "x", R("v"))


def _rgb(spark, sf_dir):
    """Three neighbouring pixels as one colour pixel."""
    unit = planes.rescale(patches(spark, sf_dir)).withColumn("i", F.col("y") * 8 + F.col("x")).where("i < 63")
    g = unit.groupBy("image", F.expr("i div 3").cast("int").alias("p"))
    return g.agg(*[F.max(F.when(F.col("i") % 3 == k, F.col("v"))).alias(c) for k, c in enumerate("rgb")]).select("image", F.lit(0).alias("y"), F.col("p").alias("x"), "r", "g", "b")


@query(f"WITH {PX}, {SPAN}, {UNIT}, c AS (SELECT image, (y * 8 + x) // 3 AS p, (y * 8 + x) % 3 AS k, v FROM unit WHERE y * 8 + x < 63) SELECT image, CAST(p AS INT) AS x, round(sum(CASE k WHEN 0 THEN 0.2125 WHEN 1 THEN 0.7154 ELSE 0.0721 END * v), 6) AS v FROM c GROUP BY image, p")
def channel_luminance(spark, sf_dir):
    return planes.luminance(_rgb(spark, sf_dir)).select("image", "x", R("v"))


@query(f"WITH {PX}, {SPAN}, {UNIT} SELECT image, y, x, round(1 - v, 6) AS v FROM unit")
def invert_background(spark, sf_dir):
    return planes.rescale(patches(spark, sf_dir)).select("image", "y", "x", F.round(1 - F.col("v"), 6).alias("v"))


@query("SELECT p_partkey, CASE WHEN w * h > 40000000 THEN 'too_large' WHEN w * h > 6000000 THEN 'slow' ELSE 'ok' END AS verdict FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 200 AS w, 100 * (p_partkey % 50 + 1) AS h FROM part)")
def size_verdict(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"w": F.col("p_size").cast("long") * 200, "h": 100 * (F.col("p_partkey") % 50 + 1)})
    return p.select("p_partkey", segment.size_verdict(F.col("w"), F.col("h")).alias("verdict"))


@query(f"WITH {PX} SELECT label AS image, y, x, round(max(v), 6) AS v FROM px GROUP BY label, y, x")
def max_projection(spark, sf_dir):
    return planes.projection(patches(spark, sf_dir), "label").select("image", "y", "x", R("v"))


HIST = f"{PX}, {SPAN}, hist AS (SELECT image, lo, hi, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INT) AS bin, count(*) AS n FROM px JOIN span USING (image) WHERE hi > lo GROUP BY ALL)"


def _best(body: str) -> str:
    return f"WITH {HIST}, {body} SELECT image, round(lo + (bin + 0.5) * (hi - lo) / 256, 6) AS threshold FROM scored QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, tie) = 1"


@query(_best("""run AS (SELECT *, CAST(sum(n) OVER u AS BIGINT) AS w1, CAST(sum(n * bin) OVER u AS BIGINT) AS s1, CAST(sum(n) OVER (PARTITION BY image) AS BIGINT) AS w, CAST(sum(n * bin) OVER (PARTITION BY image) AS BIGINT) AS s FROM hist WINDOW u AS (PARTITION BY image ORDER BY bin ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT image, lo, hi, bin, bin AS tie, w1 * (w - w1) * pow(CAST(s1 AS DOUBLE) / w1 - CAST(s - s1 AS DOUBLE) / (w - w1), 2) AS score FROM run WHERE w1 < w)"""))
def otsu_histogram(spark, sf_dir):
    return planes.otsu(patches(spark, sf_dir)).select("image", R("threshold"))


@query(_best("""run AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS c, CAST(sum(n * n) OVER u AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY image) AS DOUBLE) AS w, CAST(sum(n * n) OVER (PARTITION BY image) AS DOUBLE) AS q FROM hist WINDOW u AS (PARTITION BY image ORDER BY bin ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT image, lo, hi, bin, bin AS tie, ln(c * (w - c) * (c * (w - c)) / (a * (q - a))) AS score FROM run WHERE c < w)"""))
def yen_histogram(spark, sf_dir):
    return planes.yen(patches(spark, sf_dir)).select("image", R("threshold"))


@query(_best("""peak AS (SELECT image, lo, hi, min(bin) AS f, max(bin) AS l, max(n) AS top, arg_min(n, bin) AS nf, arg_max(n, bin) AS nl FROM hist GROUP BY ALL),
tops AS (SELECT peak.*, (SELECT min(bin) FROM hist WHERE hist.image = peak.image AND hist.n = peak.top) AS p FROM peak),
ends AS (SELECT *, CASE WHEN p - f >= l - p THEN f ELSE l END AS e, CASE WHEN p - f >= l - p THEN nf ELSE nl END AS ne FROM tops),
filled AS (SELECT ends.*, b.bin, coalesce(hist.n, 0) AS n FROM ends, (SELECT CAST(unnest(range(256)) AS INT) AS bin) b LEFT JOIN hist ON hist.image = ends.image AND hist.bin = b.bin WHERE b.bin BETWEEN least(p, e) AND greatest(p, e)),
scored AS (SELECT image, lo, hi, bin, abs(bin - e) AS tie, CASE WHEN p = e THEN 0 ELSE CAST((bin - e) * (top - ne) AS DOUBLE) / (p - e) + ne - n END AS score FROM filled)"""))
def triangle_histogram(spark, sf_dir):
    return planes.triangle(patches(spark, sf_dir)).select("image", R("threshold"))


@query(f"WITH {PX}, t AS (SELECT image, avg(v) AS threshold FROM px GROUP BY image) SELECT image, count(*) FILTER (v > threshold) AS n_on FROM px JOIN t USING (image) GROUP BY image")
def foreground_mask(spark, sf_dir):
    px = patches(spark, sf_dir)
    on = planes.foreground(px, px.groupBy("image").agg(F.avg("v").alias("threshold")))
    return on.groupBy("image").agg(F.count_if("on").alias("n_on"))


def _kernel(spark, sf_dir, f, out="double"):
    return planes.by_kernel(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, f, out)


CUT = 0.05
#: 4-connected components by least pixel number, walked recursively.
CC = f"""{PX}, on_ AS (SELECT image, y * 8 + x AS i, y, x, {{value}} AS c FROM px WHERE {{value}} > 0),
near AS (SELECT a.image, a.i AS a, b.i AS b FROM on_ a JOIN on_ b ON a.image = b.image AND a.c = b.c AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT image, i AS a, i AS b FROM on_ UNION SELECT r.image, r.a, n.b FROM reach r JOIN near n ON r.image = n.image AND r.b = n.a),
roots AS (SELECT image, a AS i, min(b) AS root FROM reach GROUP BY image, a)"""
ON = f"CASE WHEN v > {CUT} THEN 1 ELSE 0 END"
COLOURS = "CASE WHEN v > 0.12 THEN 2 WHEN v > 0.02 THEN 1 ELSE 0 END"


@query(f"WITH RECURSIVE {CC.format(value=ON)} SELECT image, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY image ORDER BY root) AS INT) AS label FROM roots")
def connected_components(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.components(a > CUT), "int").where("v > 0").withColumnRenamed("v", "label")


@query(f"WITH RECURSIVE {CC.format(value=COLOURS)} SELECT roots.image, CAST(roots.i // 8 AS INT) AS y, CAST(roots.i % 8 AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY roots.image ORDER BY c, root) AS INT) AS label FROM roots JOIN on_ ON roots.image = on_.image AND roots.i = on_.i")
def decode_colored_mask(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: scoring.decode_colours((a > 0.12).astype(int) + (a > 0.02)), "int").where("v > 0").withColumnRenamed("v", "label")


@query(f"WITH RECURSIVE {CC.format(value=ON)}, sized AS (SELECT *, count(*) OVER (PARTITION BY image, root) AS n FROM roots) SELECT image, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY image ORDER BY root) AS INT) AS label FROM sized WHERE n >= 3")
def drop_small(spark, sf_dir):
    labels = _kernel(spark, sf_dir, lambda a: kernels.components(a > CUT), "int").withColumnRenamed("v", "label")
    return measure.small_dropped(labels, 3).where("label > 0").select("image", "y", "x", "label")


@query(f"""WITH RECURSIVE {PX}, off_ AS (SELECT image, y, x FROM px WHERE v <= {CUT}),
open_ AS (SELECT image, y, x FROM off_ WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT o.image, o.y, o.x FROM open_ r JOIN off_ o ON o.image = r.image AND abs(o.y - r.y) + abs(o.x - r.x) = 1)
SELECT image, 64 - count(*) AS n_on FROM open_ GROUP BY image""")
def fill_holes(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.fill_holes(a > CUT).astype(int), "int").groupBy("image").agg(F.sum("v").alias("n_on")).where("n_on < 64")


@query(f"WITH {PX} SELECT a.image, a.y, a.x, round(min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 6) AS v FROM px a JOIN px b ON a.image = b.image WHERE a.v > {CUT} AND b.v <= {CUT} GROUP BY a.image, a.y, a.x")
def distance_transform(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.distance(a > CUT) if not (a > CUT).all() else a * 0).where("v > 0").select("image", "y", "x", R("v"))


@query(f"""WITH {PX}, k AS (SELECT CAST(unnest(range(-4, 5)) AS INT) AS d), w AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * d * d)) FROM k) AS g FROM k),
across AS (SELECT a.image, a.y, a.x, sum(g * b.v) AS v FROM px a, w JOIN px b ON b.image = a.image AND b.y = a.y AND b.x = greatest(0, least(7, a.x + d)) GROUP BY ALL)
SELECT a.image, a.y, a.x, round(sum(g * b.v), 6) AS v FROM across a, w JOIN across b ON b.image = a.image AND b.x = a.x AND b.y = greatest(0, least(7, a.y + d)) GROUP BY ALL""")
def gaussian_smooth(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.gaussian(a, 1.0, np.float64)).select("image", "y", "x", R("v"))


# ---- object measurement on quadrant labels

LABELLED = f"lab AS (SELECT image, y, x, v, {quadrant_sql('v', 0)} AS label FROM px), obj AS (SELECT image, CAST(label AS BIGINT) AS object_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(y) AS t, min(x) AS l, max(y) + 1 AS b, max(x) + 1 AS r, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy, avg(v) * 255 AS mi, max(v) * 255 AS ma, min(v) * 255 AS mn FROM lab WHERE label > 0 GROUP BY ALL)"


def _regions(spark, sf_dir):
    return measure.regions(patches(spark, sf_dir).withColumn("label", quadrant("v", 0)))


@query(f"WITH {PX}, {LABELLED} SELECT image, object_id, CAST(area AS DOUBLE) AS area_pixels, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter_pixels, round(mi, 6) AS mean_intensity, round(ma, 6) AS maximum_intensity, round(mn, 6) AS minimum_intensity FROM obj")
def region_measure(spark, sf_dir):
    return _regions(spark, sf_dir).select("image", "object_id", "area_pixels", *map(R, ("centroid_x", "centroid_y", "equivalent_diameter_pixels", "mean_intensity", "maximum_intensity", "minimum_intensity")))


@query(f"""WITH {PX}, {LABELLED}, e AS (SELECT image, object_id, (vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + vxy * vxy) AS a, greatest(0, (vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + vxy * vxy)) AS b FROM obj)
SELECT image, object_id, round(4 * sqrt(a), 4) AS major_axis_pixels, round(4 * sqrt(b), 4) AS minor_axis_pixels, round(CASE WHEN a > 0 THEN sqrt(greatest(0, 1 - b / a)) ELSE 0 END, 4) AS eccentricity FROM e""")
def ellipse_moments(spark, sf_dir):
    return _regions(spark, sf_dir).select("image", "object_id", *[R(c, 4) for c in ("major_axis_pixels", "minor_axis_pixels", "eccentricity")])


@query(f"WITH {PX}, {LABELLED} SELECT image, object_id, t <= 0 OR l <= 0 OR b >= 8 OR r >= 8 AS touches_border FROM obj")
def border_flag(spark, sf_dir):
    return _regions(spark, sf_dir).select("image", "object_id", measure.touches_border(8, 8).alias("touches_border"))


@query(f"WITH {PX}, {LABELLED} SELECT image, object_id, round(area * 0.25, 6) AS area_um2, round(cx * 0.5, 6) AS centroid_x_um, round(cy * 0.5, 6) AS centroid_y_um, round(sqrt(4 * area / pi()) * 0.5, 6) AS equivalent_diameter_um FROM obj")
def micron_scale(spark, sf_dir):
    return measure.in_microns(_regions(spark, sf_dir), 0.5).select("image", "object_id", *map(R, ("area_um2", "centroid_x_um", "centroid_y_um", "equivalent_diameter_um")))


# ---- image algorithms without a SQL form: tests hold them against brute force


@query()
def watershed(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.separate(a > 0, seed_depth=0.25, smoothing=0), "int").where("v > 0")


@query(f"""WITH RECURSIVE {PX}, eps AS (SELECT image, 4 * 1.1920928955078125e-07 * greatest(1, max(abs(v))) AS e FROM px GROUP BY image),
reach AS (SELECT p.image, p.y AS py, p.x AS px, p.v AS pv, e, p.y, p.x, p.v FROM px p JOIN eps USING (image)
UNION SELECT r.image, r.py, r.px, r.pv, r.e, n.y, n.x, n.v FROM reach r JOIN px n ON n.image = r.image AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1 WHERE n.v > r.pv - 0.1 + r.e AND r.v <= r.pv + r.e)
SELECT image, py AS y, px AS x, 1 AS v FROM reach GROUP BY image, py, px, pv, e HAVING max(v) <= pv + e""")
def h_maxima(spark, sf_dir):
    """SQL: a pixel counts if no way that stays less than the depth below it leads to a higher one."""
    return _kernel(spark, sf_dir, lambda a: kernels.prominent_maxima(a, 0.1).astype(int), "int").where("v > 0")


@query(f"""WITH {PX}, top AS (SELECT a.image, a.y, a.x, a.v FROM px a JOIN px b ON a.image = b.image AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL HAVING a.v >= max(b.v) AND a.v > 0)
SELECT image, y, x, CAST(row_number() OVER (PARTITION BY image ORDER BY v DESC, y, x) AS INT) AS v FROM top""")
def peak_seeds(spark, sf_dir):
    """Numbered from the brightest. Patches have no equal neighbours, so that no maximum clears another."""
    def seeds(a):
        out = np.zeros(a.shape, int)
        for n, at in enumerate(kernels.peaks(a, a > 0, 2), 1):
            out[at] = n
        return out

    return _kernel(spark, sf_dir, seeds, "int").where("v > 0")


def _step(name: str, source: str, pick: str, near: str) -> str:
    """An erosion (min) or dilation (max) of a relation of pixels."""
    return f"{name} AS (SELECT a.image, a.y, a.x, {pick}(b.v) AS v FROM {source} a JOIN {source} b ON a.image = b.image AND {near} GROUP BY ALL)"


CROSS, ROUND = "abs(a.y - b.y) + abs(a.x - b.x) <= 1", "(a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4"


@query(f"WITH {PX}, on_ AS (SELECT image, y, x, CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM px), {_step('e1', 'on_', 'min', CROSS)}, {_step('d1', 'e1', 'max', CROSS)}, {_step('d2', 'd1', 'max', CROSS)}, {_step('e2', 'd2', 'min', CROSS)} SELECT image, y, x, v FROM e2 WHERE v > 0")
def opening_closing(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.closing(kernels.opening(a > 0, kernels.disk(1)), kernels.disk(1)).astype(int), "int").where("v > 0")


@query(f"WITH {PX}, {_step('e1', 'px', 'min', ROUND)}, {_step('d1', 'e1', 'max', ROUND)}, t AS (SELECT px.image, px.y, px.x, px.v - d1.v AS v FROM px JOIN d1 USING (image, y, x)), r AS (SELECT image, min(v) AS lo, max(v) AS hi FROM t GROUP BY image) SELECT image, y, x, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM t JOIN r USING (image)")
def white_tophat(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: kernels.even_out(a, 2, np.float64)).select("image", "y", "x", R("v"))


@query(f"""WITH RECURSIVE {PX}, base AS (SELECT image, v - min(v) OVER w AS v, min(v) OVER w AS lo FROM px WINDOW w AS (PARTITION BY image)),
gap AS (SELECT image, min(d) / 2 AS tol FROM (SELECT image, v - lag(v) OVER (PARTITION BY image ORDER BY v) AS d FROM (SELECT DISTINCT image, v FROM base)) WHERE d IS NOT NULL GROUP BY image),
it AS (SELECT image, 0 AS k, avg(v) AS t, false AS done FROM base JOIN gap USING (image) GROUP BY image
UNION ALL SELECT image, k + 1, CASE WHEN low > 0 AND high IS NOT NULL THEN new ELSE t END, NOT coalesce(low > 0 AND high IS NOT NULL AND abs(new - t) > tol, false) FROM (SELECT *, (low - high) / (ln(low) - ln(high)) AS new FROM
 (SELECT it.image, k, t, tol, avg(v) FILTER (v <= t) AS low, avg(v) FILTER (v > t) AS high FROM it JOIN base USING (image) JOIN gap USING (image) WHERE NOT done AND k < 1000 GROUP BY ALL))),
fin AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY image ORDER BY k DESC) = 1)
SELECT image, round(t + lo, 6) AS threshold FROM fin JOIN (SELECT DISTINCT image, lo FROM base) USING (image)""")
def li_threshold(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: np.array([[kernels.threshold_of(a, "li")]])).select("image", F.round("v", 6).alias("threshold"))


#: A mask with a ring of background, and its pixels beside background (4-connected).
WIDE = f"{PX}, grid AS (SELECT image, CAST(unnest(range(-1, 9)) AS INT) AS y FROM embeddings_ids), wide AS (SELECT g.image, g.y, h.x, CASE WHEN px.v > {CUT} THEN 1 ELSE 0 END AS v FROM grid g JOIN (SELECT CAST(unnest(range(-1, 9)) AS INT) AS x) h ON true LEFT JOIN px ON px.image = g.image AND px.y = g.y AND px.x = h.x)".replace("embeddings_ids", "(SELECT vec_id AS image FROM embeddings)")


@query(f"""WITH {WIDE}, edge AS (SELECT a.image, a.y, a.x FROM wide a JOIN wide b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 WHERE a.v = 1 GROUP BY ALL HAVING min(b.v) = 0),
code AS (SELECT a.image, a.y, a.x, 1 + sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 1 THEN 2 WHEN 2 THEN 10 ELSE 0 END) AS c FROM edge a JOIN edge b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
p AS (SELECT image, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM code GROUP BY image),
cuts AS (SELECT a.image, sum(CASE WHEN a.y = b.y OR a.x = b.x THEN 1 ELSE 1 / sqrt(2) END) / 2 AS n FROM wide a JOIN wide b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y, a.x) < (b.y, b.x) WHERE a.v <> b.v GROUP BY a.image)
SELECT vec_id AS image, round(coalesce(perimeter, 0), 6) AS perimeter, round(coalesce(pi() / 4 * n, 0), 6) AS crofton FROM embeddings LEFT JOIN p ON p.image = vec_id LEFT JOIN cuts ON cuts.image = vec_id""")
def perimeters(spark, sf_dir):
    """Border path and Crofton perimeter of each patch's foreground."""
    def lengths(a):
        m = a > CUT
        return np.array([[kernels.perimeter(m), kernels.crofton(m)]])

    return _kernel(spark, sf_dir, lengths).groupBy("image").pivot("x", [0, 1]).agg(F.round(F.first("v"), 6)).select("image", F.col("0").alias("perimeter"), F.col("1").alias("crofton"))


@query()
def convex_area(spark, sf_dir):
    """Pixels in the convex hull of each patch's foreground."""
    return _kernel(spark, sf_dir, lambda a: np.array([[kernels.convex_area(a > CUT) if (a > CUT).any() else 0]]), "int").select("image", F.col("v").alias("convex_area"))


def encoded(spark, sf_dir):
    """(path, content): each patch as a PNG, enlarged fourfold; dealt out anew, as the pixels' work outweighs the bytes."""
    from ..functions.codecs import to_png

    def encode(batches):
        for b in batches:
            b["content"] = [to_png(np.kron(kernels.to_unit(np.asarray(p, np.float32).reshape(8, 8)), np.ones((4, 4)))) for p in b["plane"]]
            yield b[["path", "content"]]

    return table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id").select(F.format_string("patch-%d.png", "vec_id").alias("path"), F.col("embedding").alias("plane")).mapInPandas(encode, "path string, content binary")


@query()
def image_batch(spark, sf_dir):
    """Encoded images through decoding, segmentation and measurement, with a damaged file among them."""
    bad = spark.createDataFrame([("broken.png", bytearray(b"this is not an image"))], "path string, content binary")
    found = segment.analyze(encoded(spark, sf_dir).union(bad))
    return found.select("path", "width", "height", "error", "n_objects", R("threshold"))


@query()
def image_objects(spark, sf_dir):
    o = segment.objects(segment.analyze(encoded(spark, sf_dir)))
    return o.select("path", "object_id", *[F.round(c, 4).alias(c) for c, t in o.dtypes if t == "double"], "touches_border")


@query()
def image_parameter_grid(spark, sf_dir):
    """Every image under every parameter set, decoded once: mean count by set."""
    found = segment.analyze(encoded(spark, sf_dir), segment.grid(method=["otsu", "li"], watershed=[True, False]))
    return found.groupBy("params").agg(F.count("*").alias("images"), F.round(F.avg("n_objects"), 6).alias("mean_objects"))


def _registry_sql() -> str:
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = [(i, *r, sources.OVERRIDES.get(r[1], {}).get("channel"), sources.OVERRIDES.get(r[1], {}).get("background"), sources.CAVEATS.get(r[1])) for i, r in enumerate(sources.SAMPLES)]
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ") AS s(place, label, file, note, channel, background, caveat)"


@query(f"SELECT * FROM {_registry_sql()}")
def sample_registry(spark, sf_dir):
    return sources.samples(spark)


@query(f"SELECT vec_id AS id, coalesce(channel, 'grayscale') AS channel, coalesce(background, 'dark') AS background, caveat FROM embeddings LEFT JOIN {_registry_sql()} ON place = vec_id % 7")
def sample_overrides(spark, sf_dir):
    """Parameters to analyse each file by: the registry's where it knows the file, else the defaults."""
    names = F.array(*[F.lit(s[1]) for s in sources.SAMPLES], F.lit("other.png"), F.lit("more.tif"))
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("some/folder/"), F.element_at(names, (F.col("vec_id") % 7 + 1).cast("int"))).alias("path"))
    return sources.with_overrides(files, sources.samples(spark)).select("id", "channel", "background", "caveat")
