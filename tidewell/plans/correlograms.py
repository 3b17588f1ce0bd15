"""Queries: correlograms, jitter nulls and synchrony."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import numeric
from tidewell.functions.columns import corr, sql_corr, sql_norm_cdf, sql_uniform
from tidewell.operators import binning, ccg, graph, pairs, synchrony, trains
from tidewell.plans.basics import SUB, subgroups
from tidewell.plans.catalog import BIN, BINS, DELTA, LAGS, REPS, SHOWN, WINDOW_BINS, Tables, query, rounded
from tidewell.sources.adapters import HOUR

Z = 1.959963984540054


def raw(t: Tables) -> DataFrame:
    return ccg.ccg(t.bins, t.pairs, -LAGS, LAGS)


def moments(t: Tables) -> DataFrame:
    return ccg.normal_moments(t.bins, t.pairs, -LAGS, LAGS, WINDOW_BINS)


def surrogate(t: Tables) -> DataFrame:
    return trains.surrogate_ccg(t.points, t.pairs, WINDOW_BINS * BIN, REPS, BIN, BINS, -LAGS, LAGS)


def normal(t: Tables) -> DataFrame:
    return ccg.normal_test(raw(t), moments(t))


@query("e1_ccg", " SELECT src, dst, lag, raw FROM ccg", ("lags",))
def e1(t: Tables) -> DataFrame:
    return raw(t)


TRACE = """, pt AS (SELECT trial_id, probe, bin, CAST(sum(n) AS DOUBLE) AS y FROM bins JOIN units USING (unit_id) GROUP BY ALL), pr AS (SELECT DISTINCT probe FROM units),
pp AS (SELECT x.probe AS pa, y.probe AS pb FROM pr x JOIN pr y ON x.probe < y.probe),
a AS (SELECT trial_id, pa, pb, bin, y AS y1 FROM pt JOIN pp ON probe = pa), b AS (SELECT trial_id, pa, pb, bin, y AS y2 FROM pt JOIN pp ON probe = pb),
e1 AS (SELECT trial_id, pa, pb, sum(y1 * y1) / 288.0 AS e1 FROM a GROUP BY ALL), e2 AS (SELECT trial_id, pa, pb, sum(y2 * y2) / 288.0 AS e2 FROM b GROUP BY ALL),
sp AS (SELECT a.trial_id, a.pa, a.pb, CAST(a.bin - b.bin AS INTEGER) AS lag, sum(y1 * y2) AS s FROM a JOIN b ON a.trial_id = b.trial_id AND a.pa = b.pa AND a.pb = b.pb AND a.bin - b.bin BETWEEN -12 AND 12 GROUP BY ALL),
al AS (SELECT trial_id, pa, pb, lag, s FROM sp UNION ALL SELECT trial_id, pa, pb, CAST(i AS INTEGER), 0.0 FROM e1 CROSS JOIN range(-12, 13) r(i)),
sm AS (SELECT trial_id, pa, pb, lag, sum(s) AS s FROM al GROUP BY ALL), en AS (SELECT trial_id, pa, pb, e1, 0.0 AS e2 FROM e1 UNION ALL SELECT trial_id, pa, pb, 0.0, e2 FROM e2),
ee AS (SELECT trial_id, pa, pb, max(e1) AS e1, max(e2) AS e2 FROM en GROUP BY ALL HAVING max(e1) > 0 AND max(e2) > 0),
cc AS (SELECT trial_id, pa, pb, lag, s / (288 - abs(lag)) / sqrt(e1 * e2) AS corr, s / (288 - abs(lag)) AS prod FROM sm JOIN ee USING (trial_id, pa, pb))"""
TRACES = ("trial_id", "pa", "pb")


def two_traces(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Activity of two probes, per trial, for every pair of probes."""
    total = t.bins.join(t.units, "unit_id").groupBy("trial_id", "probe", "bin").agg(F.sum("n").cast("double").alias("y"))
    probes = t.units.select("probe").distinct()
    both = probes.select(F.col("probe").alias("pa")).join(probes.select(F.col("probe").alias("pb")), F.col("pa") < F.col("pb"))
    a, b = total.withColumnRenamed("probe", "pa").join(both, "pa"), total.withColumnRenamed("probe", "pb").join(both, "pb")
    return a.select(*TRACES, "bin", F.col("y").alias("y1")), b.select(*TRACES, "bin", F.col("y").alias("y2"))


@query("e2_cross_corr", TRACE + " SELECT trial_id, pa, pb, lag, round(corr, 6) AS corr FROM cc")
def e2(t: Tables) -> DataFrame:
    return rounded(ccg.cross_corr(*two_traces(t), TRACES, BINS, -LAGS, LAGS), "corr")


@query("e2_cross_corr_peak", TRACE + " SELECT trial_id, pa, pb, arg_max(lag, (round(corr, 9), -lag)) AS lag, round(max(corr), 6) AS corr FROM cc GROUP BY ALL")
def e2b(t: Tables) -> DataFrame:
    return rounded(ccg.peak(rounded(ccg.cross_corr(*two_traces(t), TRACES, BINS, -LAGS, LAGS), "corr", digits=9), TRACES), "corr")


@query("e3_cross_prod", TRACE + " SELECT trial_id, pa, pb, lag, round(prod, 6) AS corr FROM cc")
def e3(t: Tables) -> DataFrame:
    return rounded(ccg.cross_corr(*two_traces(t), TRACES, BINS, -LAGS, LAGS, normalise=False), "corr")


DENSE = """, pr AS (SELECT DISTINCT probe FROM units), pp AS (SELECT x.probe AS pa, y.probe AS pb FROM pr x JOIN pr y ON x.probe < y.probe),
line AS (SELECT trial_id, pa, pb, CAST(i AS BIGINT) AS bin FROM trials CROSS JOIN pp CROSS JOIN range(0, 288) r(i)),
pt AS (SELECT trial_id, probe, bin, CAST(sum(n) AS DOUBLE) AS y FROM bins JOIN units USING (unit_id) GROUP BY ALL),
a AS (SELECT l.trial_id, pa, pb, l.bin, coalesce(y, 0) AS y1 FROM line l LEFT JOIN pt ON pt.trial_id = l.trial_id AND pt.bin = l.bin AND probe = pa),
b AS (SELECT l.trial_id, pa, pb, l.bin, coalesce(y, 0) AS y2 FROM line l LEFT JOIN pt ON pt.trial_id = l.trial_id AND pt.bin = l.bin AND probe = pb),
ab AS (SELECT a.trial_id, a.pa, a.pb, CAST(a.bin - b.bin AS INTEGER) AS lag, y1, y2 FROM a JOIN b ON a.trial_id = b.trial_id AND a.pa = b.pa AND a.pb = b.pb AND a.bin - b.bin BETWEEN -12 AND 12)"""


def dense_traces(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The same with a row for every bin: pairs of probes x trials x bins, a few rows for each event of a busy session."""
    a, b = two_traces(t)
    frame = t.trials.select("trial_id").join(a.select("pa", "pb").distinct())
    return binning.dense(a, frame, BINS, "y1"), binning.dense(b, frame, BINS, "y2")


@query("e4_pearson_lags", DENSE + " SELECT trial_id, pa, pb, lag, round(" + sql_corr("y1", "y2") + ", 6) AS r FROM ab GROUP BY ALL")
def e4(t: Tables) -> DataFrame:
    return rounded(ccg.pearson_lags(*dense_traces(t), TRACES, -LAGS, LAGS), "r")


@query("e5_centred_xcorr", DENSE + f""", ma AS (SELECT trial_id, pa, pb, avg(y1) AS m1, sum(y1 * y1) - sum(y1) * sum(y1) / 288 AS e1 FROM a GROUP BY ALL), mb AS (SELECT trial_id, pa, pb, avg(y2) AS m2, sum(y2 * y2) - sum(y2) * sum(y2) / 288 AS e2 FROM b GROUP BY ALL)
SELECT trial_id, pa, pb, lag, round(sum((y1 - m1) * (y2 - m2)) / sqrt(max(e1) * max(e2)), 6) AS xcorr, round({Z} / sqrt(288), 6) AS level FROM ab JOIN ma USING (trial_id, pa, pb) JOIN mb USING (trial_id, pa, pb) WHERE e1 * e2 > 0 GROUP BY trial_id, pa, pb, lag""")
def e5(t: Tables) -> DataFrame:
    return rounded(ccg.centred_xcorr(*dense_traces(t), TRACES, BINS, -LAGS, LAGS), "xcorr", "level")


@query("e6_interval_jitter", " SELECT unit_id, trial_id, rep, t_us FROM moved WHERE rep <= 10", ("jitter",))
def e6(t: Tables) -> DataFrame:
    return ccg.interval_jitter(t.points, 4 * HOUR, SHOWN)


@query("e7_basic_jitter", f""" SELECT unit_id, trial_id, rep, CAST(t_us - 7200000000 + floor({sql_uniform("concat_ws('/', unit_id, trial_id, t_us, rep, 0)")} * 14400000000) AS BIGINT) AS t_us
 FROM points CROSS JOIN (SELECT CAST(i AS INTEGER) AS rep FROM range(1, 11) r(i))""")
def e7(t: Tables) -> DataFrame:
    return ccg.basic_jitter(t.points, 4 * HOUR, SHOWN)


@query("e8_mc_test", f""", u AS (SELECT src, dst, lag, raw, {sql_uniform("concat_ws('/', src, dst, lag, 0)")} AS ur FROM ccg),
j AS (SELECT src, dst, lag, raw AS jit, {sql_uniform("concat_ws('/', src, dst, lag, rep, 0)")} AS uj FROM surrogate)
SELECT src, dst, lag, max(raw) AS raw, round(avg(jit), 6) AS mean, round(quantile_cont(jit, 0.025), 6) AS ci_lo, round(quantile_cont(jit, 0.975), 6) AS ci_hi,
round((count(*) FILTER (jit > raw) + 1) / (count(*) + 1), 6) AS p, round((count(*) FILTER (jit + uj > raw + ur) + 1) / (count(*) + 1), 6) AS p_rnd FROM u JOIN j USING (src, dst, lag) GROUP BY ALL""", ("surrogate",))
def e8(t: Tables) -> DataFrame:
    return rounded(ccg.mc_test(raw(t), surrogate(t), REPS), "mean", "ci_lo", "ci_hi", "p", "p_rnd")


BAND = """, sc AS (SELECT src, dst, lag, count(*) AS n, CAST(sum(raw) AS BIGINT) AS s, CAST(sum(raw * raw) AS BIGINT) AS q FROM surrogate GROUP BY ALL HAVING count(*) * sum(raw * raw) > sum(raw) * sum(raw)),
zs AS (SELECT src, dst, lag, n, s, CAST(s AS DOUBLE) / n AS m, sqrt(CAST(n * q - s * s AS DOUBLE)) AS root FROM sc),
ends AS (SELECT src, dst, rep, max(round((raw * n - s) / root, 9)) AS top, min(round((raw * n - s) / root, 9)) AS low FROM surrogate JOIN zs USING (src, dst, lag) GROUP BY ALL),
own AS (SELECT src, dst, max(round((raw * n - s) / root, 9)) AS rt, min(round((raw * n - s) / root, 9)) AS rl FROM ccg JOIN zs USING (src, dst, lag) GROUP BY ALL),
q AS (SELECT src, dst, quantile_cont(top, 0.975) AS qt, quantile_cont(low, 0.025) AS ql, avg(CASE WHEN rt < top THEN 1.0 ELSE 0.0 END) AS pu, avg(CASE WHEN rl > low THEN 1.0 ELSE 0.0 END) AS pd FROM ends JOIN own USING (src, dst) GROUP BY ALL),
band AS (SELECT src, dst, lag, raw, m, ql * root / n + m AS ci_lo, qt * root / n + m AS ci_hi, pu, pd FROM ccg JOIN zs USING (src, dst, lag) JOIN q USING (src, dst))"""


@query("e9_simultaneous_band", BAND + " SELECT src, dst, lag, raw, round(m, 6) AS mean, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(pu, 6) AS p_up, round(pd, 6) AS p_down FROM band", ("surrogate",))
def e9(t: Tables) -> DataFrame:
    return rounded(ccg.simultaneous_band(raw(t), surrogate(t), REPS), "mean", "ci_lo", "ci_hi", "p_up", "p_down")


@query("e10_poisson_mean", " SELECT src, dst, lag, raw, round(mean, 6) AS mu FROM ccg JOIN moments USING (src, dst, lag)", ("moments",))
def e10(t: Tables) -> DataFrame:
    return rounded(raw(t).join(ccg.poisson_mean(t.bins, t.pairs, -LAGS, LAGS, WINDOW_BINS), ["src", "dst", "lag"]), "mu")


@query("e10_poisson_test")
def e10b(t: Tables) -> DataFrame:
    return ccg.poisson_test(raw(t), ccg.poisson_mean(t.bins, t.pairs, -LAGS, LAGS, WINDOW_BINS))


@query("e11_normal_test", f""" SELECT src, dst, lag, raw, round(mean, 6) AS mean, round(mean - {Z} * sqrt(var), 6) AS ci_lo, round(mean + {Z} * sqrt(var), 6) AS ci_hi,
 round(CASE WHEN var > 0 THEN 1 - {sql_norm_cdf("((raw - mean) / sqrt(var))")} WHEN raw > mean THEN 0.0 ELSE 1.0 END, 6) AS p FROM ccg JOIN moments USING (src, dst, lag)""", ("moments",))
def e11(t: Tables) -> DataFrame:
    return rounded(normal(t), "mean", "ci_lo", "ci_hi", "p")


@query("e12_binom_test")
def e12(t: Tables) -> DataFrame:
    return ccg.mass_test(raw(t), ccg.window_product(t.bins, t.pairs, -LAGS, LAGS, WINDOW_BINS), WINDOW_BINS)


@query("e12_binom_windows", " SELECT src, dst, lag, m, n, count(*) AS times FROM windows GROUP BY ALL", ("windows",))
def e12b(t: Tables) -> DataFrame:
    return ccg.window_product(t.bins, t.pairs, -LAGS, LAGS, WINDOW_BINS).groupBy("src", "dst", "lag", "m", "n").agg(F.count("*").alias("times"))


@query("e13_smoothed_mean", """, sm AS (SELECT unit_id, trial_id, bin + k AS bin, sum(n) AS n FROM bins CROSS JOIN range(-24, 25) r(k) WHERE bin + k BETWEEN 0 AND 287 GROUP BY ALL),
x AS (SELECT p.src, p.dst, CAST(y.bin - x.bin AS INTEGER) AS lag, sum(x.n * y.n) AS s FROM pairs p JOIN sm x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin - x.bin BETWEEN -12 AND 12 GROUP BY ALL)
SELECT p.src, p.dst, l.lag, round(coalesce(s, 0) / 49.0, 6) AS mu FROM pairs p CROSS JOIN lags l LEFT JOIN x ON x.src = p.src AND x.dst = p.dst AND x.lag = l.lag""", ("lags",))
def e13(t: Tables) -> DataFrame:
    return rounded(ccg.smoothed_mean(t.bins, t.pairs, -LAGS, LAGS, 24, BINS), "mu")


@query("e13_window_mean", """, xb AS (SELECT unit_id, trial_id, w * 48 + k AS bin, n / 48.0 AS v FROM (SELECT unit_id, trial_id, bin // 48 AS w, sum(n) AS n FROM bins GROUP BY ALL) CROSS JOIN range(0, 48) r(k)),
x AS (SELECT p.src, p.dst, CAST(y.bin - x.bin AS INTEGER) AS lag, sum(x.v * y.n) AS s FROM pairs p JOIN xb x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin - x.bin BETWEEN -12 AND 12 GROUP BY ALL)
SELECT p.src, p.dst, l.lag, round(coalesce(s, 0), 6) AS mu FROM pairs p CROSS JOIN lags l LEFT JOIN x ON x.src = p.src AND x.dst = p.dst AND x.lag = l.lag""", ("lags",))
def e13b(t: Tables) -> DataFrame:
    """x replaced by its jitter window's mean. y bins fall in the window of bin - lag, so windows meet, not bins; what
    the shifted y leaves of the trial's ends has no window to meet."""
    return rounded(ccg.poisson_mean(t.bins, t.pairs, -LAGS, LAGS, WINDOW_BINS), "mu")


@query("e14_pair_tests", BAND + f""", mc AS (SELECT src, dst, lag, max(c.raw) AS raw, avg(s.raw) AS mean, quantile_cont(s.raw, 0.975) AS hi, quantile_cont(s.raw, 0.025) AS lo, (count(*) FILTER (s.raw > c.raw) + 1) / (count(*) + 1) AS p
 FROM ccg c JOIN surrogate s USING (src, dst, lag) GROUP BY ALL)
SELECT src, dst, lag, raw, 'normal' AS kind, round(mean, 6) AS mean, round(mean - {Z} * sqrt(var), 6) AS ci_lo, round(mean + {Z} * sqrt(var), 6) AS ci_hi,
 round(CASE WHEN var > 0 THEN 1 - {sql_norm_cdf("((raw - mean) / sqrt(var))")} WHEN raw > mean THEN 0.0 ELSE 1.0 END, 6) AS p FROM ccg JOIN moments USING (src, dst, lag)
UNION ALL SELECT src, dst, lag, raw, 'mc', round(mean, 6), round(lo, 6), round(hi, 6), round(p, 6) FROM mc UNION ALL SELECT src, dst, lag, raw, 'mc_sim', round(m, 6), round(ci_lo, 6), round(ci_hi, 6), round(pu, 6) FROM band""", ("moments", "surrogate"))
def e14(t: Tables) -> DataFrame:
    """Each source unit's surrogates are made once and shared by its pairs and by both tests on them."""
    return rounded(named_tests(t, ("normal", "mc", "mc_sim")), "mean", "ci_lo", "ci_hi", "p")


@query("e14_mass_tests")
def e14b(t: Tables) -> DataFrame:
    """The tests by name that end in a mass function or a tail."""
    return named_tests(t, ("binom", "poisson", "poisson_pmf", "normal_pmf"))


def named_tests(t: Tables, kinds: tuple[str, ...]) -> DataFrame:
    return ccg.pair_tests(t.points, t.pairs, kinds, BIN, BINS, -LAGS, LAGS, WINDOW_BINS, REPS)


@query("e15_group_ccg", """ SELECT m.group_id, CAST(y.bin - x.bin AS INTEGER) AS lag, CAST(sum(x.n * y.n) AS BIGINT) AS raw FROM membership m JOIN bins x ON x.unit_id = m.src AND x.trial_id = m.trial_id
 JOIN bins y ON y.unit_id = m.dst AND y.trial_id = m.trial_id AND y.bin - x.bin BETWEEN -12 AND 12 WHERE group_id IS NOT NULL GROUP BY ALL""", ("membership",))
def e15(t: Tables) -> DataFrame:
    from tidewell.operators.timejoin import delays

    x = t.bins.select(F.col("unit_id").alias("src"), "trial_id", F.col("bin").alias("t_us"), F.col("n").alias("nx"))
    y = t.bins.select(F.col("unit_id").alias("dst"), "trial_id", F.col("bin").alias("t_us"), F.col("n").alias("ny"))
    met = delays(x.join(t.membership.where("group_id is not null"), ["src", "trial_id"]), y, -LAGS - 1, LAGS, ("dst", "trial_id"))
    return met.groupBy("group_id", F.col("d").cast("int").alias("lag")).agg(F.sum(F.col("nx") * F.col("ny")).alias("raw"))


SIGN = f""", sg AS (SELECT src, dst, sum(greatest(raw - (mean + {Z} * sqrt(var)), 0)) AS area_up, sum(greatest(mean - {Z} * sqrt(var) - raw, 0)) AS area_down FROM ccg JOIN moments USING (src, dst, lag) GROUP BY ALL)"""


def signs(t: Tables) -> DataFrame:
    return ccg.significance(normal(t), 2.0)


@query("e16_significance", SIGN + " SELECT src, dst, round(area_up, 6) AS area_up, round(area_down, 6) AS area_down, area_up > 2 AS up, area_down > 2 AS down FROM sg", ("moments",))
def e16(t: Tables) -> DataFrame:
    return rounded(signs(t), "area_up", "area_down")


@query("e17_by_probe_pair", SIGN + """ SELECT a.probe AS src_probe, b.probe AS dst_probe, count(*) AS n_pairs, count(*) FILTER (area_up > 2 OR area_down > 2) AS n_significant
 FROM sg JOIN units a ON a.unit_id = src JOIN units b ON b.unit_id = dst GROUP BY ALL""", ("moments",))
def e17(t: Tables) -> DataFrame:
    return pairs.with_attributes(signs(t), t.units).groupBy("src_probe", "dst_probe").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("up") | F.col("down")).alias("n_significant"))


@query("e18_method_comparison", f""", m AS (SELECT src, dst, lag, avg(raw) AS mc FROM surrogate GROUP BY ALL),
sm AS (SELECT unit_id, trial_id, bin + k AS bin, sum(n) AS n FROM bins CROSS JOIN range(-24, 25) r(k) WHERE bin + k BETWEEN 0 AND 287 GROUP BY ALL),
x AS (SELECT p.src, p.dst, CAST(y.bin - x.bin AS INTEGER) AS lag, sum(x.n * y.n) / 49.0 AS s FROM pairs p JOIN sm x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin - x.bin BETWEEN -12 AND 12 GROUP BY ALL)
SELECT src, dst, lag, raw, round(mc, 6) AS mc, round(mean, 6) AS window_mean, round(coalesce(s, 0), 6) AS smoothed FROM ccg JOIN moments USING (src, dst, lag) JOIN m USING (src, dst, lag) LEFT JOIN x USING (src, dst, lag)""", ("moments", "surrogate"))
def e18(t: Tables) -> DataFrame:
    key = ["src", "dst", "lag"]
    mc = ccg.mc_test(raw(t), surrogate(t), REPS).select(*key, F.col("mean").alias("mc"))
    smooth = ccg.smoothed_mean(t.bins, t.pairs, -LAGS, LAGS, 24, BINS).withColumnRenamed("mu", "smoothed")
    out = raw(t).join(moments(t), key).join(mc, key).join(smooth, key)
    return rounded(out.select(*key, "raw", "mc", F.col("mean").alias("window_mean"), "smoothed"), "mc", "window_mean", "smoothed")


@query("e18_model_p")
def e18b(t: Tables) -> DataFrame:
    """Per pair: the smallest exact p over lags, the likelihood-ratio p, and the surrogate p of the synchrony strength."""
    from tidewell.plans.regressions import lrt

    binom = e12(t).groupBy("src", "dst").agg(F.min("p").alias("p_binom"))
    beta = beta_test(t).select("src", "dst", F.col("p").alias("p_beta"))
    return binom.join(lrt(t).select("src", "dst", F.col("p").alias("p_lrt")), ["src", "dst"], "left").join(beta, ["src", "dst"], "left")


@query("e19_unit_correlograms", SIGN + """, hub AS (SELECT unit_id FROM units ORDER BY (SELECT count(*) FROM sg WHERE (area_up > 2 OR area_down > 2) AND (src = unit_id OR dst = unit_id)) DESC, unit_id LIMIT 1)
SELECT CASE WHEN c.src = unit_id THEN c.dst ELSE c.src END AS other, CASE WHEN c.src = unit_id THEN lag ELSE -lag END AS lag, raw FROM ccg c JOIN sg ON sg.src = c.src AND sg.dst = c.dst JOIN hub ON unit_id IN (c.src, c.dst) WHERE area_up > 2 OR area_down > 2""", ("moments",))
def e19(t: Tables) -> DataFrame:
    hits = signs(t).where("up or down").select("src", "dst")
    n = graph.degrees(t.units, hits).orderBy(F.desc("degree"), "unit_id").first()
    return ccg.unit_correlograms(raw(t), hits, n.unit_id)


@query("e20_covariance_density", """, lg AS (SELECT CAST(i AS INTEGER) AS lag FROM range(0, 13) r(i)), s AS (SELECT x.unit_id, CAST(y.bin - x.bin AS INTEGER) AS lag, sum(x.n * y.n) AS s FROM bins x JOIN bins y
 ON y.unit_id = x.unit_id AND y.trial_id = x.trial_id AND y.bin - x.bin BETWEEN 0 AND 12 GROUP BY ALL), r AS (SELECT unit_id, sum(n) / (288.0 * (SELECT count(*) FROM trials) * 0.083) AS rate FROM bins GROUP BY ALL)
SELECT unit_id, lag, round(coalesce(s, 0) / ((288 - lag) * (SELECT count(*) FROM trials)) / (0.083 * 0.083) - rate * rate, 6) AS density FROM r CROSS JOIN lg LEFT JOIN s USING (unit_id, lag)""")
def e20(t: Tables) -> DataFrame:
    return rounded(ccg.covariance_density(t.bins, BINS, t.n_trials, 0.083, LAGS), "density")


@query("e21_group_correlation", SUB + """, g AS (SELECT probe_from, probe_to, group_id, trial_id, t_us // 3600000000 AS bin, count(*) AS n FROM points JOIN subgroups USING (unit_id) GROUP BY ALL),
fr AS (SELECT DISTINCT a.probe_from, a.probe_to, a.group_id, t.trial_id, CAST(h AS BIGINT) AS bin FROM (SELECT DISTINCT probe_from, probe_to, group_id FROM g) a CROSS JOIN trials t CROSS JOIN range(0, 24) r(h)),
d AS (SELECT fr.*, coalesce(n, 0) AS n FROM fr LEFT JOIN g USING (probe_from, probe_to, group_id, trial_id, bin))
SELECT a.probe_from, a.probe_to, a.group_id AS g0, b.group_id AS g1, a.bin, round(""" + sql_corr("a.n", "b.n") + """, 6) AS r FROM d a JOIN d b ON b.probe_from = a.probe_to AND b.probe_to = a.probe_from AND b.trial_id = a.trial_id AND b.bin = a.bin WHERE a.probe_from < a.probe_to GROUP BY ALL""")
def e21(t: Tables) -> DataFrame:
    key = ("probe_from", "probe_to", "group_id")
    trace = binning.bins(t.points.join(subgroups(t), "unit_id"), HOUR, keys=(*key, "trial_id"))
    frame = trace.select(*key).distinct().join(t.trials.select("trial_id"))
    d = binning.dense(trace, frame, 24)
    b = d.select(F.col("probe_from").alias("probe_to"), F.col("probe_to").alias("probe_from"), F.col("group_id").alias("g1"), "trial_id", "bin", F.col("n").alias("m"))
    met = d.where("probe_from < probe_to").withColumnRenamed("group_id", "g0").join(b, ["probe_from", "probe_to", "trial_id", "bin"])
    return rounded(met.groupBy("probe_from", "probe_to", "g0", "g1", "bin").agg(corr("n", "m").alias("r")), "r")


MEMCORR = """, c0 AS (SELECT trial_id, group_id, count(*) AS n FROM membership JOIN path0 USING (src, dst) WHERE group_id IS NOT NULL GROUP BY ALL), c1 AS (SELECT trial_id, group_id, count(*) AS n FROM membership JOIN path1 USING (src, dst) WHERE group_id IS NOT NULL GROUP BY ALL),
fr AS (SELECT trial_id, CAST(g AS INTEGER) AS group_id FROM trials CROSS JOIN range(0, 5) r(g)), f0 AS (SELECT fr.*, coalesce(n, 0) AS n FROM fr LEFT JOIN c0 USING (trial_id, group_id)), f1 AS (SELECT fr.*, coalesce(n, 0) AS n FROM fr LEFT JOIN c1 USING (trial_id, group_id))
SELECT a.group_id AS g0, b.group_id AS g1, round(""" + sql_corr("a.n", "b.n") + """, 6) AS r, count(*) AS trials FROM f0 a JOIN f1 b USING (trial_id) GROUP BY a.group_id, b.group_id"""


@query("e22_membership_correlation", MEMCORR, ("pathways",))
def e22(t: Tables) -> DataFrame:
    frame = t.trials.select("trial_id").withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    parts = []
    for i, path in enumerate((t.pathway("probeA", "probeB"), t.pathway("probeB", "probeC"))):
        n = t.membership.join(path, ["src", "dst"], "left_semi").groupBy("trial_id", "group_id").agg(F.count("*").alias("n"))
        parts.append(frame.join(n, ["trial_id", "group_id"], "left").select("trial_id", F.col("group_id").alias(f"g{i}"), F.coalesce("n", F.lit(0)).alias(f"n{i}")))
    return rounded(parts[0].join(parts[1], "trial_id").groupBy("g0", "g1").agg(corr("n0", "n1").alias("r"), F.count("*").alias("trials")), "r")


@query("e22_correlation_p")
def e22b(t: Tables) -> DataFrame:
    return ccg_p(e22(t))


def ccg_p(corrs: DataFrame) -> DataFrame:
    """The same with p: two-sided, by Student's t of r sqrt((n - 2) / (1 - r^2))."""
    @F.pandas_udf("double")
    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else numeric.t_sf2(a * ((b - 2) / max(1 - a * a, 1e-300)) ** 0.5, b - 2) for a, b in zip(r, n, strict=True)], dtype="float64")

    return corrs.withColumn("p", tail("r", "trials"))


COV = """, x AS (SELECT vec_id, CAST(i AS INTEGER) - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(1, 65) r(i)),
cov AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL)"""


@query("e23_covariance", COV + " SELECT i, j, round(cov, 9) AS cov FROM cov")
def e23(t: Tables) -> DataFrame:
    from tidewell.operators.series import covariance

    return rounded(covariance(t.read("embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))), "cov", digits=9)


@query("e23_correlation", COV + """ SELECT c.i, c.j, round(c.cov / sqrt(a.cov * b.cov), 6) AS r, round(0.5 * ln((1 + c.cov / sqrt(a.cov * b.cov)) / (1 - c.cov / sqrt(a.cov * b.cov))), 6) AS fisher
 FROM cov c JOIN cov a ON a.i = c.i AND a.j = c.i JOIN cov b ON b.i = c.j AND b.j = c.j WHERE c.i < c.j""")
def e23b(t: Tables) -> DataFrame:
    from tidewell.operators.series import correlations, covariance

    r = correlations(covariance(t.read("embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))))
    return rounded(r.withColumn("fisher", ccg.fisher(F.col("r"))), "r", "fisher")


@query("e23_partial_correlation")
def e23c(t: Tables) -> DataFrame:
    from tidewell.operators.series import covariance, partial_correlations

    return partial_correlations(covariance(t.read("embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))))


SYNC = "JOIN points x ON x.unit_id = p.src JOIN points y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND abs(y.t_us - x.t_us) <= 300000000"


@query("f1_synchrony", f" SELECT p.src, p.dst, x.trial_id, count(*) AS n FROM pairs p {SYNC} WHERE x.t_us >= 3600000000 AND x.t_us < 82800000000 GROUP BY ALL")
def f1(t: Tables) -> DataFrame:
    return synchrony.synchrony(t.points, t.pairs, DELTA, HOUR, 23 * HOUR)


@query("f1_binned_synchrony", " SELECT p.src, p.dst, x.trial_id, CAST(sum(x.n * y.n) AS BIGINT) AS n FROM pairs p JOIN bins x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin = x.bin GROUP BY ALL")
def f1b(t: Tables) -> DataFrame:
    return synchrony.binned_synchrony(t.bins, t.pairs)


def jitter_sql(moved: str) -> str:
    return f""", r AS (SELECT p.src, p.dst, count(*) AS s FROM pairs p {SYNC} GROUP BY ALL), {moved}
j AS (SELECT p.src, p.dst, x.rep, count(*) AS j FROM pairs p {SYNC.replace("points x", "shifted x")} GROUP BY ALL),
v AS (SELECT p.src, p.dst, k.rep, coalesce(r.s, 0) AS s, coalesce(j.j, 0) AS n FROM pairs p CROSS JOIN (SELECT CAST(i AS INTEGER) AS rep FROM range(1, 201) q(i)) k
 LEFT JOIN r ON r.src = p.src AND r.dst = p.dst LEFT JOIN j ON j.src = p.src AND j.dst = p.dst AND j.rep = k.rep)
SELECT src, dst, s, round((count(*) FILTER (n >= s) + 1) / 201.0, 6) AS p,
 round((count(*) FILTER (n + 0.5 * {sql_uniform("concat_ws('/', src, dst, rep, 0)")} >= s + 0.5 * {sql_uniform("concat_ws('/', src, dst, 0)")}) + 1) / 201.0, 6) AS p_rnd FROM v GROUP BY src, dst, s"""


@query("f2_jitter_p", jitter_sql("shifted AS (SELECT * FROM moved),"), ("jitter",))
def f2(t: Tables) -> DataFrame:
    return rounded(synchrony.jitter_p(t.points, t.pairs, DELTA, 4 * HOUR, REPS), "p", "p_rnd")


@query("f2_basic_jitter_p", jitter_sql(f"""shifted AS (SELECT p.unit_id, p.trial_id, r.rep, CAST(t_us - 7200000000 + floor({sql_uniform("concat_ws('/', p.unit_id, p.trial_id, p.t_us, r.rep, 0)")} * 14400000000) AS BIGINT) AS t_us
 FROM points p CROSS JOIN (SELECT CAST(i AS INTEGER) AS rep FROM range(1, 201) q(i)) r),"""))
def f2b(t: Tables) -> DataFrame:
    return rounded(synchrony.jitter_p(t.points, t.pairs, DELTA, 4 * HOUR, REPS, basic=True), "p", "p_rnd")


@query("f3_tail_p")
def f3(t: Tables) -> DataFrame:
    """Poisson and Binomial tails of each pair's synchrony: mean and rate from the jitter windows."""
    @F.pandas_udf("double")
    def poisson(n: pd.Series, mu: pd.Series) -> pd.Series:
        return pd.Series([numeric.above(*numeric.poisson_masses(b), int(a) - 1) for a, b in zip(n, mu, strict=True)])

    @F.pandas_udf("double")
    def binomial(s: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([numeric.binom_sf(int(a), int(b), min(1.0, c)) for a, b, c in zip(s, n, p, strict=True)])

    both = synchrony.closed_beta(t.bins, t.pairs, WINDOW_BINS).join(synchrony.closed_beta_mean(t.bins, t.pairs, WINDOW_BINS), ["src", "dst"])
    mu = F.col("mean_cnt") * F.col("n_x")
    return both.select("src", "dst", "s", "n_x", mu.alias("mu"), poisson("s", mu).alias("p_poisson"), binomial("s", "n_x", "mean_cnt").alias("p_binomial"))


BETA = """, nx AS (SELECT unit_id AS src, CAST(sum(n) AS BIGINT) AS n_x, count(*) AS bx FROM bins GROUP BY ALL),
s AS (SELECT p.src, p.dst, CAST(sum(x.n * y.n) AS BIGINT) AS s, sum(y.n) AS sb FROM pairs p JOIN bins x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin = x.bin GROUP BY ALL),
h AS (SELECT DISTINCT unit_id AS src, trial_id, bin // 48 AS w FROM bins), z AS (SELECT p.src, p.dst, sum(y.n) AS s0 FROM pairs p JOIN h ON h.src = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = h.trial_id AND y.bin // 48 = h.w GROUP BY ALL)"""


@query("f4_closed_beta", BETA + """ SELECT p.src, p.dst, coalesce(s, 0) AS s, n_x, round(coalesce(s, 0) / n_x, 6) AS b1_cnt, round(coalesce(sb, 0) / bx, 6) AS b1_binary, round(coalesce(s0, 0) / n_x, 6) AS b0,
 CASE WHEN s > 0 THEN round(ln(s / n_x), 6) END AS log_b1 FROM pairs p JOIN nx USING (src) LEFT JOIN s USING (src, dst) LEFT JOIN z USING (src, dst)""")
def f4(t: Tables) -> DataFrame:
    return rounded(synchrony.closed_beta(t.bins, t.pairs, WINDOW_BINS), "b1_cnt", "b1_binary", "b0", "log_b1")


@query("f5_closed_beta_mean", """, wx AS (SELECT unit_id, trial_id, bin // 48 AS w, sum(n) AS c FROM bins GROUP BY ALL), nx AS (SELECT unit_id AS src, sum(n) AS n_x FROM bins GROUP BY ALL),
s AS (SELECT p.src, p.dst, sum(y.c * (1 - (1 - 1 / 48.0) ** x.c)) AS sb, sum(y.c * x.c) AS sc FROM pairs p JOIN wx x ON x.unit_id = p.src JOIN wx y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.w = x.w GROUP BY ALL)
SELECT p.src, p.dst, round(coalesce(sb, 0) / n_x, 6) AS mean_binary, round(coalesce(sc, 0) / (n_x * 48), 6) AS mean_cnt FROM pairs p JOIN nx USING (src) LEFT JOIN s USING (src, dst)""")
def f5(t: Tables) -> DataFrame:
    return rounded(synchrony.closed_beta_mean(t.bins, t.pairs, WINDOW_BINS), "mean_binary", "mean_cnt")


BETA_NULL = BETA + """, j AS (SELECT p.src, p.dst, x.rep, sum(x.n * y.n) AS j FROM pairs p JOIN moved_bins x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin = x.bin GROUP BY ALL),
v AS (SELECT p.src, p.dst, coalesce(s.s, 0) / n_x AS beta, coalesce(j.j, 0) / n_x AS jb FROM pairs p JOIN nx USING (src) CROSS JOIN (SELECT CAST(i AS INTEGER) AS rep FROM range(1, 201) q(i)) k LEFT JOIN s ON s.src = p.src AND s.dst = p.dst LEFT JOIN j ON j.src = p.src AND j.dst = p.dst AND j.rep = k.rep)"""


@query("f6_beta_test", BETA_NULL + """ SELECT src, dst, round(beta, 6) AS beta, round(avg(jb), 6) AS mean, round(quantile_cont(jb, 0.025), 6) AS ci_lo, round(quantile_cont(jb, 0.975), 6) AS ci_hi, round((count(*) FILTER (jb >= beta) + 1) / 201.0, 6) AS p FROM v GROUP BY src, dst, v.beta""", ("jitter",))
def f6(t: Tables) -> DataFrame:
    return rounded(beta_test(t), "beta", "mean", "ci_lo", "ci_hi", "p")


@query("f6_beta_corrected", BETA_NULL + """, wc AS (SELECT unit_id, trial_id, bin // 48 AS w, sum(n) AS c FROM bins GROUP BY ALL),
fr AS (SELECT p.src, p.dst, sum(y.c * x.c) AS sc FROM pairs p JOIN wc x ON x.unit_id = p.src JOIN wc y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.w = x.w GROUP BY ALL),
os AS (SELECT p.src, p.dst, coalesce(sc, 0) / (n_x * 48) AS o FROM pairs p JOIN nx USING (src) LEFT JOIN fr ON fr.src = p.src AND fr.dst = p.dst)
SELECT v.src, v.dst, round(v.beta - o, 9) AS beta, round(avg(jb) - o, 9) AS mean, round(quantile_cont(jb, 0.025) - o, 9) AS ci_lo, round(quantile_cont(jb, 0.975) - o, 9) AS ci_hi, round((count(*) FILTER (jb >= v.beta) + 1) / 201.0, 9) AS p
 FROM v JOIN os ON os.src = v.src AND os.dst = v.dst GROUP BY v.src, v.dst, v.beta, o""", ("jitter",))
def f6d(t: Tables) -> DataFrame:
    """The same less the mean that free moves in the windows have."""
    return rounded(beta_test(t, "cnt"), "beta", "mean", "ci_lo", "ci_hi", "p", digits=9)


def beta_test(t: Tables, correct: str | None = None) -> DataFrame:
    same_bin = trains.surrogate_ccg(t.points, t.pairs, WINDOW_BINS * BIN, REPS, BIN, BINS, 0, 0)
    return synchrony.beta_mc_test(t.bins, same_bin, t.pairs, REPS, correct=correct, delta=WINDOW_BINS)


@query("f6_beta_poisson")
def f6c(t: Tables) -> DataFrame:
    """The Poisson null, less its mean."""
    return synchrony.beta_poisson_test(t.bins, t.pairs, WINDOW_BINS, "cnt")


@query("f6_beta_exact")
def f6b(t: Tables) -> DataFrame:
    """Synchrony of x against binary y under window jitter, by the exact occupancy law of each window."""
    n_x = t.bins.groupBy(F.col("unit_id").alias("src")).agg(F.count("*").alias("bins_x"))
    tested = synchrony.beta_exact_test(t.bins, t.pairs, WINDOW_BINS)
    return tested.join(n_x, "src").select("src", "dst", "s", (F.col("mean") * F.col("bins_x")).alias("mean"), "p")


@query("f6_beta_exact_corrected")
def f6e(t: Tables) -> DataFrame:
    """The strength of binary x and its interval, less the exact null mean."""
    return synchrony.beta_exact_test(t.bins, t.pairs, WINDOW_BINS, correct=True)


@query("f10_train_nll", """, r AS (SELECT unit_id, sum(n) / (288.0 * (SELECT count(*) FROM trials)) AS rate FROM bins GROUP BY ALL)
SELECT g.unit_id, g.trial_id, round(288 * rate - coalesce(sum(b.n), 0) * ln(rate), 6) AS nll FROM grid g JOIN r USING (unit_id) LEFT JOIN bins b ON b.unit_id = g.unit_id AND b.trial_id = g.trial_id GROUP BY g.unit_id, g.trial_id, rate""")
def f10(t: Tables) -> DataFrame:
    rate = t.bins.groupBy("unit_id").agg(F.ln(F.sum("n") / (BINS * t.n_trials)).alias("log_rate"))
    grid = t.frame.join(rate, "unit_id").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))))
    return rounded(synchrony.train_nll(t.bins, grid), "nll")


@query("w2_pair_screen", SIGN + """, a AS (SELECT s.*, x.probe AS src_probe, y.probe AS dst_probe FROM sg s JOIN units x ON x.unit_id = src JOIN units y ON y.unit_id = dst)
SELECT src_probe, dst_probe, count(*) AS n_pairs, count(*) FILTER (area_up > 2) AS n_significant, round(count(*) FILTER (area_up > 2) / count(*), 6) AS ratio FROM a GROUP BY src_probe, dst_probe
UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (area_up > 2), round(count(*) FILTER (area_up > 2) / count(*), 6) FROM a""", ("moments",))
def w2(t: Tables) -> DataFrame:
    """Which pairs have more near-coincident events than slow rates explain? Counts per probe pair and in all."""
    tests = pairs.with_attributes(signs(t).withColumn("significant", F.col("up")), t.units)
    return rounded(binning.significant_shares(tests.withColumn("probes", F.struct("src_probe", "dst_probe"))), "ratio")


