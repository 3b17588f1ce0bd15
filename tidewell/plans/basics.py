"""Queries: sources, selection, joins, aggregates, windows and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import corr, sql_corr, sql_uniform
from tidewell.operators import binning, graph, pairs, select, series, timejoin, trains
from tidewell.plans.catalog import BIN, BINS, LENGTH, Tables, query, rounded
from tidewell.sources import files
from tidewell.sources.adapters import DAY, HOUR
from tidewell.sources.shared import shared_folder


def scratch(t: Tables) -> str:
    """A new folder in the session's shared folder."""
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


EDGES = "src BIGINT, dst BIGINT, pval DOUBLE, h DOUBLE, src_area STRING, dst_area STRING, significant BOOLEAN, src_probe STRING, dst_probe STRING"
EDGE_SQL = " SELECT src, dst, round(pval, 6) AS pval, round(h, 6) AS h, src_probe, dst_probe, src_area, dst_area, significant FROM edges"


@query("a1_read_results", EDGE_SQL, ("edges",))
def a1(t: Tables) -> DataFrame:
    a, b = scratch(t), scratch(t)
    e = rounded(t.edges, "pval", "h")
    files.write_results(e.where("src_probe < 'probeC'"), a)
    files.write_results(e.where("src_probe >= 'probeC'"), b)
    schema = e.select("src", "dst", "pval", "h", "src_area", "dst_area", "significant", "src_probe", "dst_probe").schema
    return files.read_results(t.spark, [a], schema).unionByName(files.read_results(t.spark, [b], schema))


@query("a2_write_edges", " SELECT src_probe, dst_probe, count(*) AS n, round(sum(h), 6) AS sum_h FROM edges GROUP BY ALL", ("edges",))
def a2(t: Tables) -> DataFrame:
    path = scratch(t)
    files.write_results(t.edges, path)
    found = files.read_results(t.spark, [path], t.edges.schema)  # without edges there is no file to take the columns from
    return rounded(found.groupBy("src_probe", "dst_probe").agg(F.count("*").alias("n"), F.sum("h").alias("sum_h")), "sum_h")


@query("a3_csv", " SELECT trial_id, start_us, condition_id, orientation, temporal_frequency, contrast FROM trials")
def a3(t: Tables) -> DataFrame:
    path = scratch(t)
    files.write_csv(t.trials, path)
    return files.read_csv(t.spark, path, t.trials.schema)


@query("a4_saved_steps", " SELECT src, dst, group_id, CAST(2 AS INTEGER) AS itr, CAST(trial_id AS INTEGER) AS trial_id FROM membership WHERE trial_id IN (1, 2, 3)", ("membership",))
def a4(t: Tables) -> DataFrame:
    path = scratch(t)
    both = t.membership.withColumn("itr", F.explode(F.array(F.lit(1), F.lit(2)))).repartition("itr", "trial_id")
    files.save_steps(both, path)
    return files.load_steps(t.spark, path, trial_ids=[1, 2, 3], last_only=True).select("src", "dst", "group_id", F.col("itr").cast("int").alias("itr"), F.col("trial_id").cast("int").alias("trial_id"))


@query("a5_session_tables", " SELECT unit_id, trial_id, t_us FROM points")
def a5(t: Tables) -> DataFrame:
    base = scratch(t)
    for name, table in (("points_raw", t.raw), ("units", t.units), ("trials", t.trials)):
        table.write.parquet(f"{base}/{name}")
    raw, units, trials = (t.spark.read.parquet(f"{base}/{n}") for n in ("points_raw", "units", "trials"))
    return timejoin.align(raw.join(units, "unit_id", "left_semi"), trials, 0, DAY)


@query("b1_select_units", " SELECT unit_id, probe, area FROM units WHERE area IN ('VISp', 'VISl', 'VISal') AND probe IN ('probeC', 'probeD')")
def b1(t: Tables) -> DataFrame:
    return select.select_units(t.units, ["VISp", "VISl", "VISal"], ["probeC", "probeD"])


@query("b2_select_trials", """ SELECT trial_id, 'by condition' AS kind FROM trials WHERE condition_id IN (1, 3) UNION ALL
 SELECT trial_id, 'by attribute' FROM trials WHERE orientation IN (45, 90) AND temporal_frequency IN (4) UNION ALL SELECT trial_id, 'baseline' FROM trials WHERE orientation IS NULL""")
def b2(t: Tables) -> DataFrame:
    kinds = {"by condition": {"conditions": [1, 3]}, "by attribute": {"orientations": [45.0, 90.0], "frequencies": [4.0]}, "baseline": {"baseline": True}}
    a, b, c = (select.select_trials(t.trials, **k).select("trial_id", F.lit(n).alias("kind")) for n, k in kinds.items())
    return a.unionAll(b).unionAll(c)


@query("b3_window", " SELECT p.unit_id, p.trial_id, p.t_us FROM points p JOIN units u USING (unit_id) JOIN trials t USING (trial_id) WHERE u.area IN ('VISp', 'VISl') AND t.condition_id IN (1, 3) AND t_us >= 21600000000 AND t_us < 64800000000")
def b3(t: Tables) -> DataFrame:
    units = select.select_units(t.units, ["VISp", "VISl"], ["probeC", "probeD"])
    trials = select.select_trials(t.trials, conditions=[1, 3])
    return timejoin.align(t.raw.join(units, "unit_id", "left_semi"), trials, 6 * HOUR, 18 * HOUR)


@query("b4_area_class", " SELECT unit_id, area, 'visual' AS class FROM units")
def b4(t: Tables) -> DataFrame:
    return t.units.select("unit_id", "area", select.area_class(F.col("area")).alias("class"))


@query("b5_pairs_with", """ SELECT src, dst, trial_id, group_id FROM membership WHERE src IN (SELECT unit_id FROM units WHERE area = 'VISpm') UNION ALL
 SELECT src, dst, trial_id, group_id FROM membership WHERE dst IN (SELECT unit_id FROM units WHERE area = 'VISl')""", ("membership",))
def b5(t: Tables) -> DataFrame:
    return select.pairs_with(t.membership, t.units.where("area = 'VISpm'"), t.units.where("area = 'VISl'"))


@query("b6_thin_edges", f""" SELECT src, dst, src_probe, dst_probe, significant AND {sql_uniform("concat_ws('/', src, dst, 0)")} < 0.5 AS significant FROM edges
 WHERE (src_probe, dst_probe) IN (('probeA', 'probeB'), ('probeC', 'probeD'), ('probeD', 'probeE'))""", ("edges",))
def b6(t: Tables) -> DataFrame:
    return select.thin_edges(t.edges, [("probeA", "probeB"), ("probeC", "probeD"), ("probeD", "probeE")], 0.5).select("src", "dst", "src_probe", "dst_probe", "significant")


@query("b7_plausible", " SELECT src, dst FROM edges WHERE abs(h) <= 20 AND abs(h / 2) <= 8", ("edges",))
def b7(t: Tables) -> DataFrame:
    models = t.edges.select("src", "dst", F.array("pval", "h").alias("beta"), F.array(F.col("h") / 2).alias("h"))
    return select.plausible(models, most_beta=20, most_h=8).select("src", "dst")


@query("b8_dense_trials", """ SELECT m.src, m.dst, m.trial_id, m.group_id FROM membership m JOIN counts x ON x.unit_id = m.src AND x.trial_id = m.trial_id
 JOIN counts y ON y.unit_id = m.dst AND y.trial_id = m.trial_id WHERE x.n > 5 AND y.n > 5""", ("membership",))
def b8(t: Tables) -> DataFrame:
    return select.dense_trials(t.membership, t.counts).select("src", "dst", "trial_id", "group_id")


@query("b9_relabel", " SELECT src, dst, trial_id, CAST(CASE group_id WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE group_id END AS INTEGER) AS group_id FROM membership", ("membership",))
def b9(t: Tables) -> DataFrame:
    return select.relabel(t.membership, {3: 1, 4: 2})


@query("c1_align", " SELECT unit_id, trial_id, t_us - 3600000000 AS t_us FROM (SELECT unit_id, trial_id, t_us FROM points WHERE t_us >= 3600000000)")
def c1(t: Tables) -> DataFrame:
    later = t.trials.withColumn("start_us", F.col("start_us") + HOUR)
    return timejoin.align(t.raw, later, 0, 23 * HOUR)


@query("c2_unit_pairs", """ SELECT a.unit_id AS src, b.unit_id AS dst, 'all' AS kind FROM units a JOIN units b ON a.unit_id < b.unit_id UNION ALL
 SELECT src, dst, 'between' FROM pairs UNION ALL SELECT a.unit_id, b.unit_id, 'within' FROM units a JOIN units b ON a.unit_id < b.unit_id AND a.probe = b.probe UNION ALL
 SELECT a.unit_id, b.unit_id, 'ordered' FROM units a, units b WHERE (a.probe, b.probe) IN (('probeC', 'probeA'), ('probeA', 'probeE'))""")
def c2(t: Tables) -> DataFrame:
    parts = [
        pairs.unit_pairs(t.units, "all").withColumn("kind", F.lit("all")), t.pairs.withColumn("kind", F.lit("between")), pairs.unit_pairs(t.units, "within_probe").withColumn("kind", F.lit("within")),
        pairs.unit_pairs(t.units, probe_pairs=[("probeC", "probeA"), ("probeA", "probeE")]).withColumn("kind", F.lit("ordered")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("c3_delay_join", """ SELECT src, dst, count(*) AS n, CAST(sum(y.t_us - x.t_us) AS BIGINT) AS total FROM pairs JOIN points x ON x.unit_id = src
 JOIN points y ON y.unit_id = dst AND y.trial_id = x.trial_id AND y.t_us - x.t_us > 0 AND y.t_us - x.t_us <= 3600000000 GROUP BY ALL""")
def c3(t: Tables) -> DataFrame:
    made = trains.totals(t.points, t.pairs, {"n": trains.met(0, LENGTH), "total": trains.delay(0, LENGTH)}).where("n > 0")
    return made.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("c4_attributes", EDGE_SQL, ("edges",))
def c4(t: Tables) -> DataFrame:
    plain = t.edges.select("src", "dst", "pval", "h", "significant")
    return rounded(pairs.with_attributes(plain, t.units), "pval", "h")


@query("c5_stack", f"""
, cell AS (SELECT src, dst, trial_id FROM membership WHERE group_id = 2 UNION ALL (SELECT src, dst, trial_id FROM membership WHERE group_id >= 0
  ORDER BY {sql_uniform("concat_ws('/', src, dst, trial_id, 0)")}, src, dst, trial_id LIMIT 2000))
SELECT src, dst, trial_id, 'x' AS side, count(*) AS n FROM cell c JOIN points p ON p.unit_id = c.src AND p.trial_id = c.trial_id GROUP BY ALL
UNION ALL SELECT src, dst, trial_id, 'y', count(*) FROM cell c JOIN points p ON p.unit_id = c.dst AND p.trial_id = c.trial_id GROUP BY ALL""".replace("c.trial_id GROUP", "c.trial_id GROUP").replace("SELECT src, dst, trial_id, 'x'", "SELECT src, dst, c.trial_id, 'x'").replace("SELECT src, dst, trial_id, 'y'", "SELECT src, dst, c.trial_id, 'y'"), ("membership",))
def c5(t: Tables) -> DataFrame:
    """A group's cells, then a hash sample of 2,000 cells of all groups: the batch of the operator."""
    cells = pairs.stack_cells(t.membership, 2).unionAll(pairs.stack_cells(t.membership, batch=2000))
    return pairs.cell_trains(cells, t.points).groupBy("src", "dst", "trial_id", "side").agg(F.count("*").alias("n"))


@query("c6_shared_cells", " SELECT src0, dst0, src1, dst1, cat0, cat1, n FROM cells", ("pathways",))
def c6(t: Tables) -> DataFrame:
    return t.cells


@query("c7_strongest_block", """
, best AS (SELECT * FROM cells WHERE n >= 2 ORDER BY n DESC, src0, dst0, src1, dst1, cat0, cat1 LIMIT 1)
SELECT a.trial_id, b.src0, b.dst0, b.src1, b.dst1 FROM best b JOIN membership a ON a.src = src0 AND a.dst = dst0 AND a.group_id = cat0
JOIN membership c ON c.src = src1 AND c.dst = dst1 AND c.group_id = cat1 AND c.trial_id = a.trial_id""", ("pathways",))
def c7(t: Tables) -> DataFrame:
    return pairs.trials_of_cell(t.membership, pairs.strongest_block(t.cells, 2).limit(1))


@query("d1_trial_metric", """ SELECT g.unit_id, g.trial_id, CAST(count(p.t_us) AS DOUBLE) AS n, round(avg(t_us), 3) AS shift, count(p.t_us) AS n_times, coalesce(min(t_us), -1) AS first_us
 FROM grid g LEFT JOIN points p ON p.unit_id = g.unit_id AND p.trial_id = g.trial_id GROUP BY ALL""")
def d1(t: Tables) -> DataFrame:
    key = ["unit_id", "trial_id"]
    n, shift, times = (binning.trial_metric(t.points, t.frame, m, empty_fill=f) for m, f in (("count", 0.0), ("shift", None), ("spike_times", None)))
    out = n.withColumnRenamed("value", "n").join(shift.withColumnRenamed("value", "shift"), key).join(times.withColumnRenamed("value", "ts"), key)
    return rounded(out.select(*key, "n", "shift", F.size("ts").cast("long").alias("n_times"), F.coalesce(F.get("ts", F.lit(0)), F.lit(-1)).alias("first_us")), "shift", digits=3)


@query("d2_binning", " SELECT unit_id, trial_id, bin, n FROM bins")
def d2(t: Tables) -> DataFrame:
    return binning.bins(t.points, BIN, 0, DAY)


GROUPS = ", groups AS (SELECT unit_id, CAST(unit_id % 2 AS INTEGER) AS group_id FROM units)"


def groups(t: Tables) -> DataFrame:
    return t.units.select("unit_id", (F.col("unit_id") % 2).cast("int").alias("group_id"))


@query("d3_group_activity", GROUPS + " SELECT group_id, trial_id, CAST(count(*) AS DOUBLE) AS n, round(avg(t_us), 3) AS shift FROM points JOIN groups USING (unit_id) GROUP BY ALL")
def d3(t: Tables) -> DataFrame:
    n, shift = (binning.group_metric(t.points, groups(t), m) for m in ("count", "shift"))
    return rounded(n.withColumnRenamed("value", "n").join(shift.withColumnRenamed("value", "shift"), ["group_id", "trial_id"]), "shift", digits=3)


SUB = """, subgroups AS (SELECT unit_id, a.probe AS probe_from, b.probe AS probe_to, CAST((unit_id + ascii(b.probe[6])) % 2 AS INTEGER) AS group_id
 FROM units a JOIN (SELECT DISTINCT probe FROM units) b ON a.probe <> b.probe)"""


def subgroups(t: Tables) -> DataFrame:
    """A unit's group towards every other probe."""
    to = t.units.select(F.col("probe").alias("probe_to")).distinct()
    group = ((F.col("unit_id") + F.ascii(F.substring("probe_to", 6, 1))) % 2).cast("int")
    return t.units.join(to, F.col("probe") != F.col("probe_to")).select("unit_id", F.col("probe").alias("probe_from"), "probe_to", group.alias("group_id"))


@query("d4_subgroup_activity", SUB + " SELECT probe_from, probe_to, group_id, trial_id, t_us // 300000000 AS bin, round(CAST(count(*) * 300.0 AS DOUBLE), 6) AS psth FROM points JOIN subgroups USING (unit_id) GROUP BY ALL")
def d4(t: Tables) -> DataFrame:
    return rounded(binning.group_trace(t.points, subgroups(t), BIN, 300.0, ("probe_from", "probe_to", "group_id")), "psth")


@query("d5_probe_trace", " SELECT trial_id, probe, bin, round(sum(n) / max(k) / 300.0, 9) AS rate FROM bins JOIN units USING (unit_id) JOIN (SELECT probe, count(*) AS k FROM units GROUP BY probe) USING (probe) GROUP BY ALL")
def d5(t: Tables) -> DataFrame:
    return rounded(binning.probe_trace(t.bins, t.units, 300.0), "rate", digits=9)


@query("d6_condition_tuning", """
, m AS (SELECT condition_id, orientation IS NULL AS base, unit_id, avg(n) AS mn FROM counts JOIN trials USING (trial_id) GROUP BY ALL),
f AS (SELECT condition_id, quantile_cont(mn, 0.8) AS floor_ FROM m GROUP BY ALL),
tn AS (SELECT condition_id, base, avg(mn) AS tuning FROM m JOIN f USING (condition_id) WHERE mn > floor_ GROUP BY ALL)
SELECT condition_id, round(tuning, 6) AS tuning, round(greatest(tuning - (SELECT tuning FROM tn WHERE base), 0), 6) AS above_baseline, round(tuning - (SELECT min(tuning) FROM tn) + 0.1, 6) AS above_least FROM tn""")
def d6(t: Tables) -> DataFrame:
    return rounded(binning.condition_tuning(t.counts, t.trials), "tuning", "above_baseline", "above_least")


PSTH = """, cm AS (SELECT condition_id, probe, unit_id, avg(n) AS mn, count(*) AS nt FROM counts JOIN units USING (unit_id) JOIN trials USING (trial_id) GROUP BY ALL),
cf AS (SELECT condition_id, probe, quantile_cont(mn, 0.5) AS fl FROM cm GROUP BY ALL), ca AS (SELECT cm.* FROM cm JOIN cf USING (condition_id, probe) WHERE mn > fl),
cz AS (SELECT condition_id, probe, sum(nt) AS cells FROM ca GROUP BY ALL),
psth AS (SELECT condition_id, probe, bin, sum(b.n) / max(cells) / 300.0 AS rate FROM bins b JOIN trials t USING (trial_id) JOIN ca USING (condition_id, unit_id) JOIN cz USING (condition_id, probe) GROUP BY ALL)"""


def condition_psth(t: Tables) -> DataFrame:
    return binning.condition_psth(t.bins, t.counts, t.units, t.trials, 300.0)


@query("d7_condition_psth", PSTH + " SELECT condition_id, probe, bin, round(rate, 9) AS rate FROM psth")
def d7(t: Tables) -> DataFrame:
    return rounded(condition_psth(t), "rate", digits=9)


def smooth_sql(source: str, keys: str, value: str, sigma: float) -> str:
    reach = int(4 * sigma + 0.5)
    return f""", ker AS (SELECT CAST(i AS BIGINT) AS k, exp(-0.5 * (i / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (j / {sigma}) ** 2)) FROM range(-{reach}, {reach + 1}) s(j)) AS w FROM range(-{reach}, {reach + 1}) r(i)),
line AS (SELECT CAST(i AS BIGINT) AS bin FROM range(0, {BINS}) r(i)), owners AS (SELECT DISTINCT {keys} FROM {source}),
smoothed AS (SELECT {keys}, bin, v AS {value} FROM (SELECT {", ".join("o." + c.strip() for c in keys.split(","))}, l.bin, sum(s.{value} * ker.w) AS v FROM owners o CROSS JOIN line l CROSS JOIN ker JOIN {source} s
  ON {" AND ".join(f"s.{c.strip()} = o.{c.strip()}" for c in keys.split(","))} AND s.bin = CASE WHEN l.bin + k < 0 THEN -1 - l.bin - k WHEN l.bin + k >= {BINS} THEN 2 * {BINS} - 1 - l.bin - k ELSE l.bin + k END GROUP BY ALL))"""


@query("d8_total_variation", PSTH + smooth_sql("psth", "condition_id, probe", "rate", 2.0) + """,
fullline AS (SELECT condition_id, probe, l.bin, coalesce(s.rate, 0) AS rate FROM owners CROSS JOIN line l LEFT JOIN smoothed s USING (condition_id, probe, bin)),
steps AS (SELECT condition_id, probe, abs(rate - lag(rate) OVER (PARTITION BY condition_id, probe ORDER BY bin)) AS step FROM fullline)
SELECT condition_id, probe, round(sum(step), 9) AS variation FROM steps GROUP BY ALL""")
def d8(t: Tables) -> DataFrame:
    smooth = binning.smooth(condition_psth(t), ("condition_id", "probe"), "rate", BINS, 2.0)
    whole = binning.dense(smooth, smooth.select("condition_id", "probe").distinct(), BINS, "rate")
    return rounded(binning.total_variation(whole, ("condition_id", "probe")), "variation", digits=9)


@query("d9_probe_psth", """, s AS (SELECT trial_id, CASE WHEN orientation IS NULL THEN 'baseline' ELSE 'task' END AS trial_set FROM trials),
cm AS (SELECT trial_set, probe, unit_id, avg(n) AS mn, count(*) AS nt FROM counts JOIN units USING (unit_id) JOIN s USING (trial_id) GROUP BY ALL),
cf AS (SELECT trial_set, probe, quantile_cont(mn, 0.5) AS fl FROM cm GROUP BY ALL), ca AS (SELECT cm.* FROM cm JOIN cf USING (trial_set, probe) WHERE mn > fl),
cz AS (SELECT trial_set, probe, sum(nt) AS cells FROM ca GROUP BY ALL)
SELECT trial_set, probe, bin, round(sum(b.n) / max(cells) / 300.0, 9) AS rate FROM bins b JOIN s USING (trial_id) JOIN ca USING (trial_set, unit_id) JOIN cz USING (trial_set, probe) GROUP BY ALL""")
def d9(t: Tables) -> DataFrame:
    sets = t.trials.select("trial_id", F.when(F.col("orientation").isNull(), "baseline").otherwise("task").alias("trial_set"))
    return rounded(binning.condition_psth(t.bins, t.counts, t.units, sets, 300.0, by=("trial_set", "probe")), "rate", digits=9)


@query("d10_train_statistics", """, g AS (SELECT unit_id, avg(gap) AS mean_gap FROM (SELECT unit_id, t_us - lag(t_us) OVER (PARTITION BY unit_id, trial_id ORDER BY t_us) AS gap FROM points) GROUP BY ALL)
SELECT c.unit_id, round(avg(n), 6) AS mean_n, round(var_pop(n), 6) AS var_n, round(avg(n) / 86400.0, 9) AS rate, round(max(mean_gap), 3) AS mean_gap FROM counts c LEFT JOIN g USING (unit_id) GROUP BY ALL""")
def d10(t: Tables) -> DataFrame:
    out = binning.train_statistics(t.points, t.counts, 86400.0)
    return rounded(rounded(rounded(out, "mean_n", "var_n"), "rate", digits=9), "mean_gap", digits=3)


@query("d11_empty_trials", " SELECT unit_id, count(*) FILTER (n = 0) AS empty FROM counts GROUP BY ALL")
def d11(t: Tables) -> DataFrame:
    return binning.empty_trials(t.counts)


@query("d12_conditions", " SELECT condition_id, count(DISTINCT orientation) AS n_orientations, string_agg(trial_id::VARCHAR, ',' ORDER BY trial_id) AS trial_ids, count(*) AS n_trials, max(contrast) AS last_contrast FROM trials GROUP BY ALL")
def d12(t: Tables) -> DataFrame:
    return binning.conditions(t.trials).select("condition_id", F.size("orientations").cast("long").alias("n_orientations"), F.array_join("trial_ids", ",").alias("trial_ids"), "n_trials", F.col("last_contrast"))


@query("d13_condition_sizes", " SELECT max(n) AS most, CAST(sum(n) AS BIGINT) AS total, count(*) AS conditions FROM (SELECT condition_id, count(*) AS n FROM trials GROUP BY ALL)")
def d13(t: Tables) -> DataFrame:
    return binning.condition_sizes(t.trials)


@query("d14_significant_shares", """ SELECT src_probe, dst_probe, count(*) AS n_pairs, count(*) FILTER (significant) AS n_significant, round(count(*) FILTER (significant) / count(*), 6) AS ratio FROM edges GROUP BY src_probe, dst_probe
 UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (significant), round(count(*) FILTER (significant) / count(*), 6) FROM edges""", ("edges",))
def d14(t: Tables) -> DataFrame:
    return rounded(binning.significant_shares(t.edges.withColumn("probes", F.struct("src_probe", "dst_probe"))), "ratio")


@query("d15_membership_counts", """ SELECT 'all' AS per, NULL::BIGINT AS a, NULL::BIGINT AS b, group_id, count(*) AS n FROM membership GROUP BY ALL UNION ALL
 SELECT 'trial', trial_id, NULL, group_id, count(*) FROM membership GROUP BY ALL UNION ALL SELECT 'pair', src, dst, group_id, count(*) FROM membership GROUP BY ALL""", ("membership",))
def d15(t: Tables) -> DataFrame:
    none = F.lit(None).cast("long")
    m = t.membership
    parts = [m.withColumns({"per": F.lit(p), "a": a, "b": b}) for p, a, b in (("all", none, none), ("trial", F.col("trial_id"), none), ("pair", F.col("src"), F.col("dst")))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("per", "a", "b", "group_id").agg(F.count("*").alias("n"))


@query("d15_membership_spread", """, c AS (SELECT src, dst, group_id, count(*) AS n FROM membership GROUP BY ALL),
f AS (SELECT p.src, p.dst, CAST(g AS INTEGER) AS group_id, coalesce(c.n, 0) AS n FROM pairs p CROSS JOIN range(0, 5) r(g) LEFT JOIN c ON c.src = p.src AND c.dst = p.dst AND c.group_id = g)
SELECT group_id, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS sd_n, round(stddev_pop(n) / sqrt(count(*)), 6) AS se_n FROM f GROUP BY ALL""", ("membership",))
def d15b(t: Tables) -> DataFrame:
    frame = t.pairs.withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n = t.membership.groupBy("src", "dst", "group_id").agg(F.count("*").alias("n"))
    sd = F.stddev_pop("n")
    full = frame.join(n, ["src", "dst", "group_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rounded(full.groupBy("group_id").agg(F.avg("n").alias("mean_n"), sd.alias("sd_n"), (sd / F.sqrt(F.count("*"))).alias("se_n")), "mean_n", "sd_n", "se_n")


@query("d16_membership_trace", f"""
 SELECT itr, group_id, count(*) AS n FROM (SELECT CAST(i AS INTEGER) AS itr, CASE WHEN group_id IS NOT NULL THEN CAST(floor({sql_uniform("concat_ws('/', src, dst, trial_id, i)")} * 5) AS INTEGER) END AS group_id
 FROM membership CROSS JOIN range(0, 3) r(i)) GROUP BY ALL""", ("membership",))
def d16(t: Tables) -> DataFrame:
    path = scratch(t)
    for i in range(3):
        files.save_steps(pairs.init_membership(t.pairs, t.counts, seed=i).withColumn("itr", F.lit(i)).repartition("trial_id"), path)
    return files.load_steps(t.spark, path).groupBy(F.col("itr").cast("int").alias("itr"), "group_id").agg(F.count("*").alias("n"))


@query("d17_portions", """, tot AS (SELECT count(*) AS t FROM membership), v AS (SELECT CAST(g AS INTEGER) AS group_id, (SELECT count(*) FROM membership WHERE group_id = g) + CASE WHEN g = 0 THEN 1.1 ELSE 1.0 END * (SELECT t FROM tot) AS v FROM range(0, 5) r(g))
 SELECT group_id, round(v / (SELECT sum(v) FROM v), 9) AS portion FROM v""", ("membership",))
def d17(t: Tables) -> DataFrame:
    from tidewell.operators.fit import portions

    return rounded(portions(t.membership), "portion", digits=9)


@query("d18_mean_beta", " SELECT CAST(k AS INTEGER) AS pos, round(avg(CASE k WHEN 0 THEN pval WHEN 1 THEN h ELSE h * h END), 6) AS beta FROM edges CROSS JOIN range(0, 3) r(k) GROUP BY ALL", ("edges",))
def d18(t: Tables) -> DataFrame:
    models = t.edges.select(F.array("pval", "h", F.col("h") * F.col("h")).alias("beta"))
    return rounded(models.select(F.posexplode("beta").alias("pos", "b")).groupBy("pos").agg(F.avg("b").alias("beta")), "beta")


@query("d19_filter_band", """ SELECT src_probe, lag, round(avg(raw), 6) AS mean, round(quantile_cont(raw, 0.025), 6) AS lo, round(quantile_cont(raw, 0.975), 6) AS hi FROM ccg JOIN (SELECT unit_id AS src, probe AS src_probe FROM units) USING (src) GROUP BY ALL""", ("lags",))
def d19(t: Tables) -> DataFrame:
    from tidewell.operators.ccg import ccg

    side = t.units.select(F.col("unit_id").alias("src"), F.col("probe").alias("src_probe"))
    band = F.percentile("raw", F.array(F.lit(0.025), F.lit(0.975)))
    out = ccg(t.bins, t.pairs, -12, 12).join(side, "src").groupBy("src_probe", "lag").agg(F.avg("raw").alias("mean"), band[0].alias("lo"), band[1].alias("hi"))
    return rounded(out, "mean", "lo", "hi")


@query("d20_edge_signs", " SELECT significant, h > 0 AS positive, count(*) AS n FROM edges GROUP BY ALL", ("edges",))
def d20(t: Tables) -> DataFrame:
    return graph.edge_signs(t.edges)


@query("d21_roc", """, s AS (SELECT n_chars / 150000.0 AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT CAST(i AS INTEGER) AS i, i / 500.0 AS threshold FROM range(0, 501) r(i))
SELECT i, threshold, round(count(*) FILTER (NOT pos AND score < threshold) / count(*) FILTER (NOT pos), 6) AS fpr, round(count(*) FILTER (pos AND score < threshold) / count(*) FILTER (pos), 6) AS tpr FROM g CROSS JOIN s GROUP BY ALL""")
def d21(t: Tables) -> DataFrame:
    from tidewell.operators.testing import roc

    docs = t.read("documents").select("doc_id", "n_chars").join(t.read("labels"), "doc_id").where("quality is not null")
    return rounded(roc(docs.select((F.col("n_chars") / 150000.0).alias("score"), (F.col("quality") == 1).alias("positive"))), "fpr", "tpr")


@query("d22_ecdf", """, g AS (SELECT CAST(i AS INTEGER) AS bin, i / 50.0 AS q FROM range(1, 51) r(i))
SELECT bin, q, round(count(*) FILTER (pval <= q) / count(*), 6) AS ecdf, round(sqrt(-ln(0.025) / 2) / sqrt(count(*)), 6) AS band FROM g CROSS JOIN edges GROUP BY ALL""", ("edges",))
def d22(t: Tables) -> DataFrame:
    from tidewell.operators.testing import ecdf

    return rounded(ecdf(t.edges, 50, value="pval"), "ecdf", "band")


RATES = ", rates AS (SELECT unit_id, probe, avg(n) AS rate FROM counts JOIN units USING (unit_id) GROUP BY ALL)"


def rates(t: Tables) -> DataFrame:
    return t.counts.groupBy("unit_id").agg(F.avg("n").alias("rate")).join(t.units.select("unit_id", "probe"), "unit_id")


@query("g1_active_units", RATES + """ SELECT unit_id, 'probe' AS kind FROM rates JOIN (SELECT probe, quantile_cont(rate, 0.7) AS f FROM rates GROUP BY ALL) USING (probe) WHERE rate > f
 UNION ALL SELECT unit_id, 'all' FROM rates WHERE rate > (SELECT quantile_cont(rate, 0.7) FROM rates)""")
def g1(t: Tables) -> DataFrame:
    r = rates(t)
    return select.active_units(r).select("unit_id", F.lit("probe").alias("kind")).unionAll(select.active_units(r, within_probe=False).select("unit_id", F.lit("all").alias("kind")))


CORR = f""", corrs AS (SELECT a.unit_id AS src, b.unit_id AS dst, ua.probe AS p0, ub.probe AS p1, coalesce({sql_corr('a.n', 'b.n')}, 0) AS r FROM counts a JOIN counts b USING (trial_id)
 JOIN units ua ON ua.unit_id = a.unit_id JOIN units ub ON ub.unit_id = b.unit_id WHERE ua.probe < ub.probe GROUP BY ALL)"""


def count_correlations(t: Tables) -> DataFrame:
    a = t.counts.join(t.units, "unit_id").select(F.col("unit_id").alias("src"), "trial_id", F.col("n").alias("x"), F.col("probe").alias("p0"))
    b = t.counts.join(t.units, "unit_id").select(F.col("unit_id").alias("dst"), "trial_id", F.col("n").alias("y"), F.col("probe").alias("p1"))
    return a.join(b, "trial_id").where("p0 < p1").groupBy("src", "dst", "p0", "p1").agg(F.coalesce(corr("x", "y"), F.lit(0.0)).alias("r"))


@query("g2_split_by_correlation", CORR + """, s AS (SELECT src AS unit_id, p0 AS probe_from, p1 AS probe_to, sum(CASE WHEN r > 0.2 THEN r ELSE 0 END) AS s FROM corrs GROUP BY ALL
 UNION ALL SELECT dst, p1, p0, sum(CASE WHEN r > 0.2 THEN r ELSE 0 END) FROM corrs GROUP BY ALL),
f AS (SELECT probe_from, probe_to, quantile_cont(s, 0.3) AS f FROM s GROUP BY ALL)
SELECT unit_id, probe_from, probe_to, CASE WHEN round(s, 9) > round(f, 9) THEN 0 ELSE 1 END AS group_id FROM s JOIN f USING (probe_from, probe_to)""")
def g2(t: Tables) -> DataFrame:
    from tidewell.operators.subgroups import split_by_correlation

    return split_by_correlation(count_correlations(t))


@query("g3_split_by_match", """, psth AS (SELECT trial_id, bin, sum(n) AS psth FROM bins GROUP BY ALL), sc AS (SELECT unit_id, CAST(sum(n * psth) AS BIGINT) AS score FROM bins JOIN psth USING (trial_id, bin) GROUP BY ALL),
f AS (SELECT quantile_cont(score, 0.6) AS f FROM sc) SELECT unit_id, CASE WHEN score > f THEN 0 ELSE 1 END AS group_id FROM sc, f""")
def g3(t: Tables) -> DataFrame:
    from tidewell.operators.subgroups import match_scores, split_by_score

    psth = t.bins.groupBy("trial_id", "bin").agg(F.sum("n").alias("psth"))
    total = match_scores(t.bins, psth).groupBy("unit_id").agg(F.sum("score").alias("score"))
    return split_by_score(total, 0.6)


@query("g4_match_scores", """, psth AS (SELECT trial_id, bin, sum(n) AS psth FROM bins GROUP BY ALL) SELECT unit_id, trial_id, CAST(sum(n * psth) AS BIGINT) AS score FROM bins JOIN psth USING (trial_id, bin) GROUP BY ALL""")
def g4(t: Tables) -> DataFrame:
    from tidewell.operators.subgroups import match_scores

    return match_scores(t.bins, t.bins.groupBy("trial_id", "bin").agg(F.sum("n").alias("psth")))


def rounds_sql(rounds: int) -> str:
    out = ", g0 AS (SELECT unit_id, probe FROM units WHERE unit_id % 2 = 0)"
    for i in range(1, rounds + 1):
        out += f""", p{i} AS (SELECT probe, trial_id, bin, sum(n) AS psth FROM bins JOIN g{i - 1} USING (unit_id) GROUP BY ALL),
s{i} AS (SELECT unit_id, u.probe, CAST(sum(n * psth) AS BIGINT) AS score FROM units u JOIN bins USING (unit_id) JOIN p{i} ON p{i}.probe = u.probe AND p{i}.trial_id = bins.trial_id AND p{i}.bin = bins.bin GROUP BY ALL),
g{i} AS (SELECT unit_id, probe FROM s{i} JOIN (SELECT probe, quantile_cont(score, 0.6) AS f FROM s{i} GROUP BY ALL) USING (probe) WHERE score > f)"""
    return out + f" SELECT unit_id, probe FROM g{rounds}"


@query("g5_subgroup_search", rounds_sql(3))
def g5(t: Tables) -> DataFrame:
    from tidewell.operators.subgroups import search

    start = t.units.where("unit_id % 2 = 0").select("unit_id", "probe")
    return search(t.bins, t.units, start, rounds=3, enough=2.0)


@query("g6_intervals", " SELECT unit_id, trial_id, t_us, t_us - lag(t_us) OVER (PARTITION BY unit_id, trial_id ORDER BY t_us) AS gap FROM points")
def g6(t: Tables) -> DataFrame:
    return binning.intervals(t.points)


@query("g7_shift", """ SELECT unit_id, trial_id, (bin + unit_id * 7 + 20160 - 288) % 288 AS bin, n, 'circular' AS kind FROM bins UNION ALL
 SELECT unit_id, trial_id, bin + unit_id * 7 - 288, n, 'padded' FROM bins WHERE bin + unit_id * 7 - 288 BETWEEN 0 AND 287""")
def g7(t: Tables) -> DataFrame:
    by = F.col("unit_id") * 7 - 288
    return series.shifted(t.bins, by, BINS, True).withColumn("kind", F.lit("circular")).unionByName(series.shifted(t.bins, by, BINS, False).withColumn("kind", F.lit("padded")))


DEGREE = """, once AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE significant), ends AS (SELECT a AS unit_id FROM once UNION ALL SELECT b FROM once),
degree AS (SELECT u.unit_id, u.probe, count(e.unit_id) AS degree FROM units u LEFT JOIN ends e USING (unit_id) GROUP BY ALL)"""


def degree(t: Tables) -> DataFrame:
    return graph.degrees(t.units, t.edges.where("significant"))


@query("g8_sorted_nodes", DEGREE + " SELECT probe, CAST(row_number() OVER (PARTITION BY probe ORDER BY degree DESC, unit_id) AS INTEGER) AS rank, unit_id, degree FROM degree", ("edges",))
def g8(t: Tables) -> DataFrame:
    return graph.sorted_nodes(degree(t))


@query("g9_peak_lag", " SELECT src, dst, lag, raw FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY raw DESC, lag) AS k FROM ccg) WHERE k = 1", ("lags",))
def g9(t: Tables) -> DataFrame:
    from tidewell.operators.ccg import ccg, peak

    return peak(ccg(t.bins, t.pairs, -12, 12).withColumnRenamed("raw", "corr"), ("src", "dst")).withColumnRenamed("corr", "raw")


@query("g10_sets", RATES + """, a AS (SELECT unit_id FROM rates WHERE rate > (SELECT quantile_cont(rate, 0.7) FROM rates)), o AS (SELECT unit_id FROM units WHERE area IN ('VISp', 'VISl'))
 SELECT unit_id, 'both' AS kind FROM a WHERE unit_id IN (FROM o) UNION ALL SELECT unit_id, 'only active' FROM a WHERE unit_id NOT IN (FROM o) UNION ALL SELECT unit_id, 'either' FROM (SELECT unit_id FROM a UNION SELECT unit_id FROM o)
 UNION ALL SELECT unit_id, 'stacked' FROM (SELECT unit_id FROM a UNION ALL SELECT unit_id FROM o)""")
def g10(t: Tables) -> DataFrame:
    a = select.active_units(rates(t), within_probe=False).select("unit_id")
    o = t.units.where(F.col("area").isin("VISp", "VISl")).select("unit_id")
    kinds = {"both": a.intersect(o), "only active": a.join(o, "unit_id", "left_anti"), "either": a.union(o).distinct(), "stacked": a.unionByName(o)}
    parts = [d.withColumn("kind", F.lit(k)) for k, d in kinds.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


