"""Queries: multiple testing, contingency, bootstrap, graphs, clusters and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.columns import laplace_pdf, norm_cdf, norm_pdf, sql_chi2_tail, sql_norm_cdf, sql_uniform
from tidewell.operators import ccg, graph, series, testing
from tidewell.plans.basics import DEGREE, PSTH, condition_psth, degree, smooth_sql
from tidewell.plans.catalog import BINS, LAGS, QUERIES, REPS, Tables, query, rounded
from tidewell.plans.correlograms import SIGN, raw, signs, surrogate
from tidewell.sources.shared import settle


@query("h1_wald", " SELECT src, dst, round(h, 6) AS h, round(pval, 6) AS pval FROM edges", ("edges",))
def h1(t: Tables) -> DataFrame:
    return rounded(t.edges.select("src", "dst", "h", "pval"), "h", "pval")


@query("h2_rank_p", """, r AS (SELECT src, dst, CAST(sum(raw) AS DOUBLE) AS h FROM ccg WHERE lag > 0 GROUP BY ALL), j AS (SELECT src, dst, rep, CAST(sum(raw) AS DOUBLE) AS hj FROM surrogate WHERE lag > 0 GROUP BY ALL)
SELECT src, dst, h, round(2 * least(avg(CASE WHEN h > hj THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN h > hj THEN 1.0 ELSE 0.0 END)), 6) AS p FROM r JOIN j USING (src, dst) GROUP BY src, dst, h""", ("surrogate",))
def h2(t: Tables) -> DataFrame:
    return rounded(ccg.height_rank(raw(t), surrogate(t), REPS), "p")


@query("h2_fit_rank_p")
def h2b(t: Tables) -> DataFrame:
    """The rank of every pair's fitted filter height among those fitted to surrogates of its source."""
    fits = QUERIES["k14_surrogate_fits"](t.spark, t.sf_dir).where("converged")
    fits = settle(fits)
    return testing.rank_p(fits.where("rep = 0").select("src", "dst", "h"), fits.where("rep > 0").select("src", "dst", "rep", "h"))


@query("h3_contingency", " SELECT src0, dst0, src1, dst1, n, round(chi2, 6) AS chi2, dof, round(sqrt(chi2 / n / 5), 6) AS cramer_v FROM chi", ("chi",))
def h3(t: Tables) -> DataFrame:
    return rounded(testing.contingency_tests(t.cells), "chi2", "cramer_v")


def tested(t: Tables) -> DataFrame:
    return testing.chi2_p(testing.contingency_tests(t.cells))


CHI_P = f", tests AS (SELECT src0, dst0, src1, dst1, chi2, n, dof, round({sql_chi2_tail('chi2', 'dof')}, 9) AS p FROM chi)"


@query("h3_contingency_p", CHI_P + " SELECT src0, dst0, src1, dst1, n, round(chi2, 6) AS chi2, dof, round(sqrt(chi2 / n / 5), 6) AS cramer_v, round(p, 6) AS p FROM tests", ("chi",))
def h3b(t: Tables) -> DataFrame:
    return rounded(tested(t), "chi2", "cramer_v", "p")


@query("h4_p_summary", """ SELECT threshold, count(*) FILTER (pval < threshold) AS n, round(avg(CASE WHEN pval < threshold THEN 1.0 ELSE 0.0 END), 6) AS ratio
 FROM edges CROSS JOIN (SELECT unnest([CAST(0.001 AS DOUBLE), 0.01, 0.05, 0.1]) AS threshold) GROUP BY ALL""", ("edges",))
def h4(t: Tables) -> DataFrame:
    return rounded(testing.p_summary(t.edges, [0.001, 0.01, 0.05, 0.1], "pval"), "ratio")


@query("h4_p_codes", " SELECT src, dst, round(-log10(pval), 6) AS neg_log, CASE WHEN pval < 0.01 THEN 2 WHEN pval < 0.05 THEN 1 END AS code FROM edges", ("edges",))
def h4b(t: Tables) -> DataFrame:
    return rounded(t.edges.select("src", "dst", (-F.log10("pval")).alias("neg_log"), testing.p_levels(F.col("pval")).alias("code")), "neg_log")


def adjust_sql(source: str, key: str, family: str) -> str:
    over = f"PARTITION BY {family}" if family else ""
    return f""", base AS (SELECT {key}, {family + "," if family else ""} p FROM {source}),
rk AS (SELECT *, count(*) OVER ({over} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, count(*) OVER ({over}) AS m FROM base),
mn AS (SELECT *, min(p * m / k) OVER ({over} ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM rk)
SELECT {key}, {family + "," if family else ""} round(p, 9) AS p, round(least(p * m, 1), 9) AS bonferroni, round(least(v, 1), 9) AS bh, round(least(v * list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i)), 1), 9) AS by FROM mn"""


@query("h5_adjust", adjust_sql("(SELECT src, dst, pval AS p FROM edges)", "src, dst", ""), ("edges",))
def h5(t: Tables) -> DataFrame:
    return rounded(testing.adjust(t.edges.select("src", "dst", F.col("pval").alias("p"))), "p", "bonferroni", "bh", "by", digits=9)


@query("h5_adjust_families", adjust_sql("(SELECT src, dst, src_probe, pval AS p FROM edges)", "src, dst", "src_probe"), ("edges",))
def h5b(t: Tables) -> DataFrame:
    return rounded(testing.adjust(t.edges.select("src", "dst", "src_probe", F.col("pval").alias("p")), ("src_probe",)), "p", "bonferroni", "bh", "by", digits=9)


def both(name: str, sql: str):
    """Register a query under its name and under the one that ends in _p, which it had first."""
    def add(f):
        return query(f"{name}_p", CHI_P + sql, ("chi",))(query(name, CHI_P + sql, ("chi",))(f))

    return add


@both("h6_hub_blocks", " SELECT dst0 AS mid, count(*) AS n, count(DISTINCT src0) AS n_src FROM tests WHERE p < 0.3 AND dst0 = src1 GROUP BY dst0 HAVING count(*) > 0.06 * 25")
def h6_p(t: Tables) -> DataFrame:
    return testing.hub_blocks(tested(t), 0.3, 0.06, 25)


@both("h6_hub_members", """, hubs AS (SELECT dst0 AS mid FROM tests WHERE p < 0.3 AND dst0 = src1 GROUP BY dst0 HAVING count(*) > 0.06 * 25)
SELECT dst0 AS mid, src0, dst1, round(p, 6) AS p FROM tests JOIN hubs ON mid = dst0 WHERE p < 0.3 AND dst0 = src1""")
def h6m_p(t: Tables) -> DataFrame:
    tests = tested(t)
    return rounded(testing.hub_members(tests, testing.hub_blocks(tests, 0.3, 0.06, 25), 0.3), "p")


@both("h6_broadcast_blocks", " SELECT src0 AS source, dst1 AS target, count(*) AS n, count(*) FILTER (dst0 = src1) AS n_hub FROM tests WHERE p < 0.3 GROUP BY ALL HAVING count(*) > 0.051 * 25")
def h6b_p(t: Tables) -> DataFrame:
    return testing.broadcast_blocks(tested(t), 0.3, 0.051, 25)


@both("h7_mean_contingency", """ SELECT cat0, cat1, round(sum(c.n) / (SELECT count(*) FROM tests), 6) AS mean_n, round(sum(CASE WHEN p < 0.3 THEN c.n ELSE 0 END) / (SELECT count(*) FROM tests WHERE p < 0.3), 6) AS mean_n_significant
 FROM cells c JOIN tests USING (src0, dst0, src1, dst1) GROUP BY ALL""")
def h7_p(t: Tables) -> DataFrame:
    return rounded(testing.mean_contingency(t.cells, tested(t), 0.3), "mean_n", "mean_n_significant")


@both("h7_cramer_v", " SELECT round(avg(sqrt(chi2 / n / 5)), 6) AS mean_v, round(avg(sqrt(chi2 / n / 5)) FILTER (p < 0.3), 6) AS mean_v_significant FROM tests")
def h7b_p(t: Tables) -> DataFrame:
    return rounded(tested(t).agg(F.avg("cramer_v").alias("mean_v"), F.avg(F.when(F.col("p") < 0.3, F.col("cramer_v"))).alias("mean_v_significant")), "mean_v", "mean_v_significant")


@both("h8_in_significant", """, e AS (SELECT src0 AS src, dst0 AS dst FROM tests WHERE p < 0.3 UNION ALL SELECT src1, dst1 FROM tests WHERE p < 0.3)
SELECT p.src, p.dst, CAST(count(e.src) > 0 AS INTEGER) AS marked, count(e.src) AS degree FROM pairs p LEFT JOIN e ON e.src = p.src AND e.dst = p.dst GROUP BY p.src, p.dst""")
def h8_p(t: Tables) -> DataFrame:
    return testing.in_significant(t.pairs, tested(t), 0.3)


@query("h9_bootstrap_table", f""", tab AS (SELECT cat0, cat1, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL), tot AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM tab),
r AS (SELECT cat0, (sum(s) OVER (ORDER BY cat0) - s) / (SELECT t FROM tot) AS lo, sum(s) OVER (ORDER BY cat0) / (SELECT t FROM tot) AS hi FROM (SELECT cat0, sum(n) AS s FROM tab GROUP BY ALL)),
c AS (SELECT cat1, (sum(s) OVER (ORDER BY cat1) - s) / (SELECT t FROM tot) AS lo, sum(s) OVER (ORDER BY cat1) / (SELECT t FROM tot) AS hi FROM (SELECT cat1, sum(n) AS s FROM tab GROUP BY ALL)),
d AS (SELECT rep, {sql_uniform("concat_ws('/', rep, i, 'row', 0)")} AS u0, {sql_uniform("concat_ws('/', rep, i, 'col', 0)")} AS u1 FROM range(1, 21) a(rep) CROSS JOIN (SELECT unnest(range(1, (SELECT t FROM tot) + 1)) AS i)),
b AS (SELECT rep, cat0, cat1, count(*) AS b FROM d JOIN r ON u0 >= r.lo AND u0 < r.hi JOIN c ON u1 >= c.lo AND u1 < c.hi GROUP BY ALL)
SELECT tab.cat0, tab.cat1, n, round(least(count(*) FILTER (coalesce(b, 0) >= n) / 20.0, 1 - count(*) FILTER (coalesce(b, 0) >= n) / 20.0), 6) AS p FROM tab CROSS JOIN range(1, 21) a(rep) LEFT JOIN b ON b.rep = a.rep AND b.cat0 = tab.cat0 AND b.cat1 = tab.cat1 GROUP BY tab.cat0, tab.cat1, n""", ("pathways",))
def h9(t: Tables) -> DataFrame:
    table = t.cells.groupBy("cat0", "cat1").agg(F.sum("n").alias("n"))
    return rounded(testing.bootstrap_table(table, 20), "p")


@query("h10_bootstrap_errors", f""", s AS (SELECT src_probe AS scenario, row_number() OVER (PARTITION BY src_probe ORDER BY src, dst) - 1 AS i, h AS x FROM edges), z AS (SELECT scenario, count(*) AS k FROM s GROUP BY ALL),
d AS (SELECT scenario, rep, CAST(floor({sql_uniform("concat_ws('/', scenario, rep, i, 0)")} * k) AS BIGINT) AS i FROM s JOIN z USING (scenario) CROSS JOIN range(1, 51) r(rep)),
b AS (SELECT scenario, rep, avg(x) AS bias, stddev_pop(x) AS se, sqrt(avg(x * x)) AS rmse FROM d JOIN s USING (scenario, i) GROUP BY ALL),
o AS (SELECT scenario, avg(x) AS bias, stddev_pop(x) AS se, sqrt(avg(x * x)) AS rmse FROM s GROUP BY ALL)
SELECT scenario, round(max(o.bias), 6) AS bias, round(max(o.se), 6) AS se, round(max(o.rmse), 6) AS rmse, round(quantile_cont(b.bias, 0.025), 6) AS bias_lo, round(quantile_cont(b.bias, 0.975), 6) AS bias_hi,
round(quantile_cont(b.se, 0.025), 6) AS se_lo, round(quantile_cont(b.se, 0.975), 6) AS se_hi, round(quantile_cont(b.rmse, 0.025), 6) AS rmse_lo, round(quantile_cont(b.rmse, 0.975), 6) AS rmse_hi FROM o JOIN b USING (scenario) GROUP BY scenario""", ("edges",))
def h10(t: Tables) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("src_probe").orderBy("src", "dst")) - 1
    sample = t.edges.select(F.col("src_probe").alias("scenario"), i.cast("long").alias("i"), F.col("h").alias("x"), F.lit(0.0).alias("x0"))
    out = testing.bootstrap_errors(sample, 50)
    return rounded(out, *[c for c in out.columns if c != "scenario"])


@query("h11_normal_qq", f""", v AS (SELECT round(h, 9) / 10.0 AS z FROM edges), g AS (SELECT CAST(i AS INTEGER) AS i, i * 0.2 - 4.0 AS z FROM range(0, 41) r(i))
SELECT g.i, round(CAST(g.z AS DOUBLE), 6) AS z, round(count(*) FILTER (ceil((v.z + 4.0) / 0.2) <= g.i) / count(*), 6) AS ecdf, round({sql_norm_cdf("CAST(g.z AS DOUBLE)")}, 6) AS normal, round(sqrt(-ln(0.025) / 2) / sqrt(count(*)), 6) AS band FROM g CROSS JOIN v GROUP BY g.i, g.z""", ("edges",))
def h11(t: Tables) -> DataFrame:
    return rounded(testing.normal_qq(t.edges.select(F.round("h", 9).alias("value")), 0.0, 10.0), "z", "ecdf", "normal", "band")


@query("l1_signed_edges", " SELECT src, dst, CASE WHEN h > 0 THEN 1 ELSE -1 END AS weight FROM edges WHERE significant", ("edges",))
def l1(t: Tables) -> DataFrame:
    return graph.signed_edges(t.edges)


@query("l2_ccg_edges", SIGN + " SELECT src, dst, 1 AS weight FROM sg WHERE area_up > 2 OR area_down > 2", ("moments",))
def l2(t: Tables) -> DataFrame:
    return graph.unit_edges(signs(t))


@query("l3_probe_graph", " SELECT src_probe, dst_probe, count(*) AS weight FROM edges WHERE significant GROUP BY ALL", ("edges",))
def l3(t: Tables) -> DataFrame:
    return graph.probe_graph(t.edges)


@query("l4_weighted_degree", " SELECT unit_id, CAST(sum(group_id) AS BIGINT) AS degree FROM (SELECT src AS unit_id, group_id FROM membership UNION ALL SELECT dst, group_id FROM membership) WHERE group_id IS NOT NULL GROUP BY ALL", ("membership",))
def l4(t: Tables) -> DataFrame:
    return graph.weighted_degree(t.membership)


@query("l5_degrees", DEGREE + " SELECT unit_id, probe, degree FROM degree", ("edges",))
def l5(t: Tables) -> DataFrame:
    return degree(t)


@query("l5_degree_statistics", DEGREE + " SELECT probe, count(*) AS n_units, round(avg(CASE WHEN degree > 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero, count(*) FILTER (degree > 1) AS hubs, round(avg(degree), 6) AS mean_degree FROM degree GROUP BY ALL", ("edges",))
def l5b(t: Tables) -> DataFrame:
    return rounded(graph.degree_statistics(degree(t), 1), "nonzero", "mean_degree")


@query("l5_hubs", DEGREE + " SELECT unit_id, probe, degree FROM degree WHERE degree >= 2", ("edges",))
def l5c(t: Tables) -> DataFrame:
    return graph.hubs(degree(t), 2)


def arrays(t: Tables) -> DataFrame:
    """Mean-corrected correlograms as arrays over the lags."""
    mean = ccg.poisson_mean(t.bins, t.pairs, -LAGS, LAGS, 48)
    d = raw(t).join(mean, ["src", "dst", "lag"]).select("src", "dst", "lag", (F.col("raw") - F.col("mu")).alias("d"))
    return d.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "d"))), lambda s: s["d"]).alias("y"))


@query("l6_unified", """, d AS (SELECT src, dst, list(raw - mean ORDER BY lag) AS y, sum(raw - mean) FILTER (lag < 0) AS l, sum(raw - mean) FILTER (lag > 0) AS r FROM ccg JOIN moments USING (src, dst, lag) GROUP BY ALL)
SELECT src, dst, CAST(lag AS INTEGER) AS lag, round(CASE WHEN round(r, 9) < round(l, 9) THEN y[13 - lag] ELSE y[13 + lag] END, 6) AS y FROM d CROSS JOIN range(-12, 13) q(lag)""", ("moments",))
def l6(t: Tables) -> DataFrame:
    out = graph.unify_direction(arrays(t).withColumn("y", F.transform("y", lambda v: F.round(v, 9))))
    return rounded(out.select("src", "dst", F.posexplode("y").alias("lag", "y")).withColumn("lag", F.col("lag") - LAGS), "y")


@query("l6_clusters")
def l6b(t: Tables) -> DataFrame:
    rows = graph.unify_direction(arrays(t).join(signs(t).where("up or down"), ["src", "dst"], "left_semi"))
    return graph.cluster(rows, "y", 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query("l7_filter_clusters")
def l7(t: Tables) -> DataFrame:
    """K-means of the fitted coefficients of all pairs whose fit converged, 8 clusters, then the mean of every coefficient."""
    from tidewell.plans.regressions import fitted

    rows = settle(fitted(t).where("converged").select("src", "dst", "beta"))
    return graph.cluster_means(graph.cluster(rows, "beta", 8), "beta")


@query("n1_smooth", PSTH + smooth_sql("psth", "condition_id, probe", "rate", 3.0) + " SELECT condition_id, probe, bin, round(rate, 9) AS rate FROM smoothed WHERE round(rate, 9) <> 0")
def n1(t: Tables) -> DataFrame:
    from tidewell.operators.binning import smooth

    return rounded(smooth(condition_psth(t), ("condition_id", "probe"), "rate", BINS, 3.0), "rate", digits=9).where("rate <> 0")


@query("n2_math", """ SELECT event_id, round(ln(value + 1), 9) AS ln_v, round(exp(-value / 100), 9) AS exp_v, round(sqrt(value), 9) AS sqrt_v, round(abs(value - 50), 9) AS abs_v, round(sin(value), 9) AS sin_v,
 CAST(floor(value) AS BIGINT) AS floor_v, CAST(ceil(value) AS BIGINT) AS ceil_v, round(greatest(least(value, 60), 40), 9) AS clip_v FROM (SELECT event_id, abs(value) AS value FROM events)""")
def n2(t: Tables) -> DataFrame:
    v = F.abs("value")
    return rounded(t.read("events").select("event_id", F.ln(v + 1).alias("ln_v"), F.exp(-v / 100).alias("exp_v"), F.sqrt(v).alias("sqrt_v"), F.abs(v - 50).alias("abs_v"), F.sin(v).alias("sin_v"), F.floor(v).alias("floor_v"), F.ceil(v).alias("ceil_v"), F.greatest(F.least(v, F.lit(60)), F.lit(40)).alias("clip_v")), "ln_v", "exp_v", "sqrt_v", "abs_v", "sin_v", "clip_v", digits=9)


@query("n3_normal_laplace", f""" SELECT event_id, round(exp(-z * z / 2) / sqrt(2 * pi()), 6) AS pdf, round({sql_norm_cdf("z")}, 6) AS cdf, round(exp(-abs(z) / 0.7) / 1.4, 6) AS laplace FROM (SELECT event_id, value / 50 - 1 AS z FROM events)""")
def n3(t: Tables) -> DataFrame:
    z = F.col("value") / 50 - 1
    return rounded(t.read("events").select("event_id", norm_pdf(z).alias("pdf"), norm_cdf(z).alias("cdf"), laplace_pdf(z, 0.7).alias("laplace")), "pdf", "cdf", "laplace")


def traces(t: Tables) -> DataFrame:
    return t.bins.join(t.units, "unit_id").groupBy("probe", "trial_id", "bin").agg(F.sum("n").cast("double").alias("y"))


@query("n4_welch")
def n4(t: Tables) -> DataFrame:
    return series.welch(traces(t), ("probe", "trial_id"), BINS, 12.0, 128)


@query("n5_spectrogram")
def n5(t: Tables) -> DataFrame:
    return series.spectrogram(traces(t), ("probe", "trial_id"), BINS, 12.0, 96, 84, 128)


@query("n6_strings", " SELECT unit_id, concat_ws('_', probe, area, unit_id) AS label, regexp_extract(probe, 'probe([A-F])', 1) AS letter FROM units")
def n6(t: Tables) -> DataFrame:
    return t.units.select("unit_id", F.concat_ws("_", "probe", "area", F.col("unit_id").cast("string")).alias("label"), F.regexp_extract("probe", "probe([A-F])", 1).alias("letter"))
