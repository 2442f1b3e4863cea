"""Queries over populations: thresholds, mixtures, controls, comparisons, dose response."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markers, positivity, scoring
from .catalog import POP, population, query, table

R = lambda c, n=6: F.round(c, n).alias(c)
finite = lambda c, n=4: F.when(F.abs(F.col(c)) < float("inf"), F.round(c, n)).alias(c)

LPDF = "(-0.5 * pow((v - {m}) / {s}, 2) - ln({s}) - 0.5 * ln(2 * pi()))"
#: Expectation maximisation as a recursive walk over rounds; one row per group and round.
EM = """val AS (SELECT grp AS g, value AS v, CAST(count(*) AS DOUBLE) AS n FROM pop GROUP BY ALL),
tot AS (SELECT grp AS g, count(*) AS nt, avg(value) AS mu, greatest(stddev_pop(value), 1e-3) AS sd, var_pop(value) AS var, median(value) AS med, min(value) AS lo, max(value) AS hi FROM pop GROUP BY grp),
cut AS (SELECT *, CASE WHEN med < hi THEN med ELSE mu END AS split FROM tot WHERE nt >= 3 AND hi > lo)"""


def em_sql(pop: str = POP) -> str:
    """Fits and calls of a relation pop (grp, value)."""
    init = """init AS (SELECT g, nt, n0 / nt AS w0, n1 / nt AS w1, m0, m1, sqrt(greatest(1e-6, (SELECT sum(n * pow(v - m0, 2)) FROM val WHERE val.g = h.g AND v <= split) / n0)) AS s0, sqrt(greatest(1e-6, (SELECT sum(n * pow(v - m1, 2)) FROM val WHERE val.g = h.g AND v > split) / n1)) AS s1
  FROM (SELECT g, nt, split, sum(n) FILTER (v <= split) AS n0, sum(n) FILTER (v > split) AS n1, sum(n * v) FILTER (v <= split) / sum(n) FILTER (v <= split) AS m0, sum(n * v) FILTER (v > split) / sum(n) FILTER (v > split) AS m1 FROM val JOIN cut USING (g) GROUP BY ALL) h)"""
    l0, l1 = (f"ln(w{k}) + {LPDF.format(m=f'm{k}', s=f's{k}')}" for k in (0, 1))
    return f"""{pop}, {EM},
{init},
em AS (SELECT g, nt, 0 AS k, w0, w1, m0, m1, s0, s1, CAST(NULL AS DOUBLE) AS ll, CAST(NULL AS DOUBLE) AS prev, false AS done FROM init
UNION ALL
SELECT g, nt, k + 1, t0 / nt, t1 / nt, a0 / t0, a1 / t1, sqrt(greatest(1e-6, q0 / t0 - pow(a0 / t0 - m0, 2))), sqrt(greatest(1e-6, q1 / t1 - pow(a1 / t1 - m1, 2))), new, ll, ll IS NOT NULL AND abs(new - ll) < 1e-6 * greatest(1, abs(ll))
FROM (SELECT g, nt, k, m0, m1, ll, sum(n * bth) AS new, greatest(1e-12, sum(n * r0)) AS t0, greatest(1e-12, sum(n * r1)) AS t1, sum(n * r0 * v) AS a0, sum(n * r1 * v) AS a1, sum(n * r0 * pow(v - m0, 2)) AS q0, sum(n * r1 * pow(v - m1, 2)) AS q1
  FROM (SELECT *, exp(l0 - bth) AS r0, exp(l1 - bth) AS r1 FROM (SELECT *, greatest(l0, l1) + ln(1 + exp(-abs(l0 - l1))) AS bth FROM (SELECT em.*, v, n, {l0} AS l0, {l1} AS l1 FROM em JOIN val USING (g) WHERE NOT done AND k < 200)))
  GROUP BY g, nt, k, m0, m1, ll)),
fin AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1),
stat AS (SELECT g, tot.nt AS n, -tot.nt * (ln(sd) + 0.5 * ln(2 * pi())) - tot.nt * var / (2 * sd * sd) AS ll1, fin.ll AS ll2, w0, w1, m0, m1, s0, s1 FROM tot LEFT JOIN fin USING (g)),
judged AS (SELECT *, coalesce((2 * ln(n) - 2 * ll1) - (5 * ln(n) - 2 * ll2), 0) AS delta_bic, coalesce(sqrt(2) * abs(m1 - m0) / sqrt(s0 * s0 + s1 * s1), 0) AS d, 1 / (2 * s0 * s0) - 1 / (2 * s1 * s1) AS a, 2 * (m1 / (2 * s1 * s1) - m0 / (2 * s0 * s0)) AS b, m0 * m0 / (2 * s0 * s0) - m1 * m1 / (2 * s1 * s1) - ln(w0 / s0) + ln(w1 / s1) AS c FROM stat),
roots AS (SELECT *, (m0 + m1) / 2 AS mid, CASE WHEN abs(a) < 1e-12 OR b * b < 4 * a * c THEN NULL ELSE (-b + sqrt(b * b - 4 * a * c)) / (2 * a) END AS r1, CASE WHEN abs(a) < 1e-12 OR b * b < 4 * a * c THEN NULL ELSE (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS r2, CASE WHEN abs(a) < 1e-12 AND abs(b) >= 1e-12 THEN -c / b END AS r0 FROM judged),
calls AS (SELECT *, delta_bic > 10 AND d > 2 AS bimodal, CASE WHEN delta_bic > 10 AND d > 2 THEN CASE WHEN r0 BETWEEN m0 AND m1 THEN r0 WHEN r1 BETWEEN m0 AND m1 THEN r1 WHEN r2 BETWEEN m0 AND m1 THEN r2 ELSE mid END END AS threshold FROM roots)"""


@query(f"WITH RECURSIVE {em_sql()}, r AS (SELECT g, n, threshold, bimodal, delta_bic, d, count(value) FILTER (value >= threshold) AS p FROM calls JOIN pop ON grp = g GROUP BY g, n, threshold, bimodal, delta_bic, d) SELECT g, n AS n_total, p AS n_positive, round(100.0 * p / n, 4) AS percent_positive, round(threshold, 3) AS threshold, bimodal, round(delta_bic, 1) AS delta_bic, round(d, 3) AS ashman_d FROM r")
def mixture_call(spark, sf_dir):
    """Percent positive per group, and whether there is a positive population at all."""
    return positivity.mixture_calls(population(spark, sf_dir), "grp", "value").select("g", "n_total", "n_positive", R("percent_positive", 4), finite("threshold", 3), "bimodal", R("delta_bic", 1), R("ashman_d", 3))


@query(f"WITH RECURSIVE {em_sql()}, e AS (SELECT event_id AS id, 'event-' || event_type AS g, value AS v FROM events UNION ALL SELECT o_orderkey, 'line-' || CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END, 20 + o_totalprice / 4000 FROM orders) SELECT id, e.g, coalesce(v >= threshold, false) AS positive, CASE WHEN bimodal THEN round(1 / (1 + exp(ln(w0) + {LPDF.format(m='m0', s='s0')} - ln(w1) - {LPDF.format(m='m1', s='s1')})), 3) ELSE 0 END AS posterior FROM e JOIN calls ON calls.g = e.g")
def mixture_objects(spark, sf_dir):
    """Calls and posteriors of objects under fits of the populations."""
    calls = positivity.mixture_calls(population(spark, sf_dir), "grp", "value")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("event-"), "event_type").alias("g"), F.col("value").alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("line-"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O")).alias("g"), (20 + F.col("o_totalprice") / 4000).alias("v"))
    return positivity.called_objects(e.union(o), "g", "v", calls).select("id", "g", "positive", R("posterior", 3))


@query(f"WITH {POP} SELECT grp AS g, count(*) AS n, round(avg(value), 4) AS mean, round(greatest(stddev_pop(value), 1e-3), 4) AS sigma, round(2 * ln(count(*)) - 2 * (-count(*) * (ln(greatest(stddev_pop(value), 1e-3)) + 0.5 * ln(2 * pi())) - count(*) * var_pop(value) / (2 * pow(greatest(stddev_pop(value), 1e-3), 2))), 2) AS bic FROM pop GROUP BY grp")
def one_component_fit(spark, sf_dir):
    from ..functions import columns as C

    g = population(spark, sf_dir).groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.var_pop("value").alias("var"))
    return g.select("g", "n", R("mean", 4), F.round(F.greatest("sd", F.lit(C.LEAST_SIGMA)), 4).alias("sigma"), F.round(C.bic(F.col("n"), C.one_normal_loglik(F.col("n"), F.col("sd"), F.col("var")), 1), 2).alias("bic"))


@query(f"WITH RECURSIVE {em_sql()} SELECT g, k AS round, round(ll, 2) AS ll, round(m0, 3) AS m0, round(m1, 3) AS m1 FROM em WHERE k > 0")
def fit_rounds(spark, sf_dir):
    """Likelihood and means of every round of each group's fit."""
    return positivity.fit_rounds(population(spark, sf_dir), "grp", "value").select("g", "round", R("ll", 2), R("m0", 3), R("m1", 3))


OTSU = """each AS (SELECT event_type, value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
run AS (SELECT event_type, v, lead(v) OVER w AS nx, sum(n) OVER u AS b, sum(n * v) OVER u AS s, sum(n) OVER (PARTITION BY event_type) AS t, sum(n * v) OVER (PARTITION BY event_type) AS a, max(v) OVER (PARTITION BY event_type) - min(v) OVER (PARTITION BY event_type) AS r FROM each WINDOW w AS (PARTITION BY event_type ORDER BY v), u AS (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING)),
best AS (SELECT event_type, (v + nx) / 2 AS threshold FROM run WHERE nx IS NOT NULL AND t >= 3 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(CAST(b AS DOUBLE) / t * (CAST(t - b AS DOUBLE) / t) * pow((s / b - (a - s) / (t - b)) / r, 2), 9) DESC, v) = 1)"""


@query(f"WITH {OTSU} SELECT event_type, round(threshold, 6) AS threshold FROM best")
def exact_otsu(spark, sf_dir):
    return markers.exact_otsu(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", finite("threshold", 6))


@query("WITH t AS (SELECT quantile_cont(value, 0.99) AS t FROM events WHERE event_type = 'error') SELECT event_type, count(*) AS n_total, count(*) FILTER (value >= t) AS n_positive, round(max(t), 6) AS threshold, round(100.0 * count(*) FILTER (value >= t) / count(*), 6) AS percent_positive FROM events, t GROUP BY event_type")
def negative_control_call(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return positivity.control_call(e, "event_type", "value", e.where("event_type = 'error'")).select("event_type", "n_total", "n_positive", R("threshold"), R("percent_positive"))


@query("SELECT event_type, count(*) AS n_total, count(*) FILTER (value >= 50) AS n_positive, round(100.0 * count(*) FILTER (value >= 50) / count(*), 6) AS percent_positive FROM events GROUP BY event_type")
def manual_call(spark, sf_dir):
    return positivity.manual_call(table(spark, sf_dir, "events"), "event_type", "value", 50).select("event_type", "n_total", "n_positive", R("percent_positive"))


@query("WITH p AS (SELECT event_type, quantile_cont(value, 0.4) AS lo, quantile_cont(value, 0.6) AS hi FROM events GROUP BY event_type) SELECT event_type, round(100.0 * count(*) FILTER (value >= lo) / count(*), 6) AS generous, round(100.0 * count(*) FILTER (value >= hi) / count(*), 6) AS strict, round(100.0 * (count(*) FILTER (value >= lo) - count(*) FILTER (value >= hi)) / count(*), 6) AS spread FROM events JOIN p USING (event_type) GROUP BY event_type")
def manual_bias(spark, sf_dir):
    """How far apart two people's manual cuts, at the 40th and 60th percentile, put the percentage."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.4), F.lit(0.6))).alias("p"))
    share = lambda i: 100 * F.count_if(F.col("value") >= F.col("p")[i]) / F.count("*")
    return e.join(p, "event_type").groupBy("event_type").agg(F.round(share(0), 6).alias("generous"), F.round(share(1), 6).alias("strict"), F.round(share(0) - share(1), 6).alias("spread"))


@query("""WITH RECURSIVE val AS (SELECT event_type AS g, value AS v, count(*) AS n FROM events GROUP BY ALL),
km AS (SELECT g, 0 AS k, min(v) AS a, max(v) AS b, false AS done FROM val GROUP BY g HAVING sum(n) >= 3 AND max(v) > min(v)
UNION ALL SELECT g, k + 1, CASE WHEN same THEN a ELSE na END, CASE WHEN same THEN b ELSE nb END, same FROM (SELECT *, abs(na - a) <= 1e-8 + 1e-5 * abs(a) AND abs(nb - b) <= 1e-8 + 1e-5 * abs(b) AS same FROM
 (SELECT g, k, a, b, coalesce(sum(n * v) FILTER (abs(v - b) >= abs(v - a)) / sum(n) FILTER (abs(v - b) >= abs(v - a)), a) AS na, coalesce(sum(n * v) FILTER (abs(v - b) < abs(v - a)) / sum(n) FILTER (abs(v - b) < abs(v - a)), b) AS nb FROM km JOIN val USING (g) WHERE NOT done AND k < 100 GROUP BY g, k, a, b)))
SELECT g, round((a + b) / 2, 4) AS threshold FROM km QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1""")
def kmeans_threshold(spark, sf_dir):
    return positivity.thresholds_by(table(spark, sf_dir, "events"), "event_type", "value", positivity.kmeans_threshold).select("g", finite("threshold", 4))


@query()
def gamma_threshold(spark, sf_dir):
    return positivity.thresholds_by(population(spark, sf_dir), "grp", "value", positivity.gamma_threshold).select("g", finite("threshold", 4))


@query()
def method_head_to_head(spark, sf_dir):
    pop = population(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("line-"), "l_linestatus").alias("g")).agg((100 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("truth"))
    none = pop.where(F.col("grp").startswith("event-")).select(F.col("grp").alias("g")).distinct().withColumn("truth", F.lit(0.0))
    return positivity.head_to_head(pop, "grp", "value", li.union(none)).select("method", R("mean_error", 4), R("on_negative", 4))


@query(f"""WITH RECURSIVE {em_sql()}, r AS (SELECT g, n, count(value) FILTER (value >= threshold) AS p, threshold, bimodal, delta_bic, d, m0, m1, s0, s1, w0, w1 FROM calls JOIN pop ON grp = g GROUP BY ALL)
SELECT g, concat_ws(chr(10), 'MARKER POSITIVITY — REPRODUCIBILITY REPORT', repeat('=', 44), rpad('image', 24, ' ') || ': ' || g, rpad('channel', 24, ' ') || ': ' || CASE WHEN g LIKE 'line-%' THEN 'line' ELSE 'event' END, rpad('pixel size', 24, ' ') || ': 0.5', rpad('method', 24, ' ') || ': mixture', rpad('objects measured', 24, ' ') || ': ' || n, rpad('marker-positive', 24, ' ') || ': ' || p,
 rpad('percent positive', 24, ' ') || ': ' || printf('%.2f%%', 100.0 * p / n), rpad('threshold (0-255)', 24, ' ') || ': ' || CASE WHEN threshold IS NULL THEN 'inf' ELSE printf('%.3f', threshold) END, rpad('distinct populations', 24, ' ') || ': ' || CASE WHEN bimodal THEN 'yes' ELSE 'no' END,
 rpad('bimodality ΔBIC', 24, ' ') || ': ' || printf('%.2f', delta_bic), rpad('negative component', 24, ' ') || ': ' || printf('mean %.2f, sd %.2f, weight %.3f', m0, s0, w0), rpad('positive component', 24, ' ') || ': ' || printf('mean %.2f, sd %.2f, weight %.3f', m1, s1, w1)) AS lines FROM r""")
def repro_report(spark, sf_dir):
    """The whole report but its note, with two lines of context."""
    calls = positivity.mixture_calls(population(spark, sf_dir), "grp", "value")
    r = positivity.report(calls, "mixture", context={"channel": F.when(F.col("g").startswith("line-"), "line").otherwise("event"), "pixel size": 0.5})
    lines = F.filter(F.split("report", "\n"), lambda x: ~F.startswith(x, F.lit("note: ")))
    return r.select("g", F.array_join(lines, "\n").alias("lines"))


DOSE = "dose AS (SELECT label, avg(CASE WHEN e.v >= 0.1 THEN 100.0 ELSE 0 END) AS pct FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e GROUP BY label)"


@query(f"WITH {DOSE} SELECT label AS dose, round(pct, 6) AS percent_positive FROM dose")
def dose_response(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return positivity.manual_call(v, "label", "v", 0.1).select(F.col("label").alias("dose"), R("percent_positive"))


@query("WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY u, p) AS rx, row_number() OVER (PARTITION BY event_type ORDER BY p, u) AS ry FROM (SELECT event_type, user_id AS u, round(avg(value), 0) AS p FROM events GROUP BY ALL)) SELECT event_type, round(corr(rx, ry), 6) AS rho FROM r GROUP BY event_type")
def spearman_ordinal(spark, sf_dir):
    """Dose is the user, response the rounded mean: ties are ranked by dose."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("u")).agg(F.round(F.avg("value"), 0).alias("p"))
    return scoring.spearman(d, "event_type", "u", "p").select("event_type", R("rho"))
