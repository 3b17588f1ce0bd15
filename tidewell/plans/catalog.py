"""The register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform
from tidewell.operators import binning, pairs
from tidewell.sources import adapters

#: The windows of the queries, for trials of a day.
BIN = 5 * adapters.MINUTE
BINS = 288
LAGS = 12
WINDOW_BINS = 48
LENGTH = adapters.HOUR
WIDTH = 2 * adapters.HOUR
DELTA = 5 * adapters.MINUTE
REPS = 200
#: Surrogates that the queries of e6 and e7 return as rows.
SHOWN = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parts of SQL that several queries use; each may use those before it.
PARTS = {
    "membership": """membership AS (SELECT p.src, p.dst, x.trial_id,
      CASE WHEN x.n > 0 AND y.n > 0 THEN CAST(floor({u_cell} * 5) AS INTEGER) END AS group_id
      FROM pairs p JOIN counts x ON x.unit_id = p.src JOIN counts y ON y.unit_id = p.dst AND y.trial_id = x.trial_id)""",
    "lags": """lags AS (SELECT CAST(i AS INTEGER) AS lag FROM range(-12, 13) t(i)),
    ccg AS (SELECT p.src, p.dst, l.lag, CAST(coalesce(s.raw, 0) AS BIGINT) AS raw FROM pairs p CROSS JOIN lags l LEFT JOIN (
      SELECT p.src, p.dst, CAST(y.bin - x.bin AS INTEGER) AS lag, sum(x.n * y.n) AS raw FROM pairs p JOIN bins x ON x.unit_id = p.src
      JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin - x.bin BETWEEN -12 AND 12 GROUP BY ALL) s
      ON s.src = p.src AND s.dst = p.dst AND s.lag = l.lag)""",
    "windows": """wy AS (SELECT unit_id AS dst, trial_id, lag, CAST(floor((bin - lag) / 48.0) AS BIGINT) AS w, CAST(sum(n) AS BIGINT) AS m FROM bins, lags GROUP BY ALL),
    wx AS (SELECT unit_id AS src, trial_id, bin // 48 AS w, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY ALL),
    windows AS (SELECT p.src, p.dst, wy.lag, wx.trial_id, wx.w, wy.m, wx.n FROM pairs p JOIN wx ON wx.src = p.src
      JOIN wy ON wy.dst = p.dst AND wy.trial_id = wx.trial_id AND wy.w = wx.w)""",
    "moments": """moments AS (SELECT p.src, p.dst, l.lag, coalesce(s.mean, 0) AS mean, coalesce(s.var, 0) AS var FROM pairs p CROSS JOIN lags l LEFT JOIN (
      SELECT src, dst, lag, sum(m / 48.0 * n) AS mean, sum(m / 48.0 * (1 - m / 48.0) * n) AS var FROM windows GROUP BY ALL) s
      ON s.src = p.src AND s.dst = p.dst AND s.lag = l.lag)""",
    "edges": """scores AS (SELECT c.src, c.dst, sum(raw) - sum(mean) AS h, (sum(raw) - sum(mean)) / sqrt(sum(var)) AS z
      FROM ccg c JOIN moments m ON m.src = c.src AND m.dst = c.dst AND m.lag = c.lag WHERE c.lag > 0 GROUP BY ALL HAVING sum(var) > 0),
    edges AS (SELECT s.src, s.dst, 2 * least({phi_z}, 1 - {phi_z}) AS pval, h, a.probe AS src_probe, b.probe AS dst_probe, a.area AS src_area, b.area AS dst_area,
      2 * least({phi_z}, 1 - {phi_z}) < 0.05 AS significant FROM scores s JOIN units a ON a.unit_id = s.src JOIN units b ON b.unit_id = s.dst)""",
    "jitter": """moved AS (SELECT p.unit_id, p.trial_id, r.rep, CAST(floor(t_us / 14400000000.0) * 14400000000 + floor({u_event} * 14400000000) AS BIGINT) AS t_us
      FROM points p CROSS JOIN (SELECT CAST(i AS INTEGER) AS rep FROM range(1, 201) t(i)) r),
    moved_bins AS (SELECT unit_id, trial_id, rep, t_us // 300000000 AS bin, count(*) AS n FROM moved GROUP BY ALL)""",
    "surrogate": """surrogate AS (SELECT p.src, p.dst, r.rep, l.lag, CAST(coalesce(s.raw, 0) AS BIGINT) AS raw FROM pairs p CROSS JOIN lags l
      CROSS JOIN (SELECT CAST(i AS INTEGER) AS rep FROM range(1, 201) t(i)) r LEFT JOIN (
      SELECT p.src, p.dst, x.rep, CAST(y.bin - x.bin AS INTEGER) AS lag, sum(x.n * y.n) AS raw FROM pairs p JOIN moved_bins x ON x.unit_id = p.src
      JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin - x.bin BETWEEN -12 AND 12 GROUP BY ALL) s
      ON s.src = p.src AND s.dst = p.dst AND s.rep = r.rep AND s.lag = l.lag)""",
    "pathways": """path0 AS (SELECT p.src, p.dst FROM pairs p JOIN units a ON a.unit_id = p.src JOIN units b ON b.unit_id = p.dst WHERE a.probe = 'probeA' AND b.probe = 'probeB'),
    path1 AS (SELECT p.src, p.dst FROM pairs p JOIN units a ON a.unit_id = p.src JOIN units b ON b.unit_id = p.dst WHERE a.probe = 'probeB' AND b.probe = 'probeC'),
    cells AS (SELECT a.src AS src0, a.dst AS dst0, b.src AS src1, b.dst AS dst1, a.group_id AS cat0, b.group_id AS cat1, count(*) AS n
      FROM membership a JOIN path0 p ON p.src = a.src AND p.dst = a.dst JOIN membership b ON b.trial_id = a.trial_id JOIN path1 q ON q.src = b.src AND q.dst = b.dst
      WHERE a.group_id IS NOT NULL AND b.group_id IS NOT NULL GROUP BY ALL)""",
    "chi": """marg AS (SELECT *, sum(n) OVER (PARTITION BY src0, dst0, src1, dst1, cat0) AS r, sum(n) OVER (PARTITION BY src0, dst0, src1, dst1, cat1) AS c,
      sum(n) OVER (PARTITION BY src0, dst0, src1, dst1) AS t FROM cells),
    sizes AS (SELECT src0, dst0, src1, dst1, max(t) AS t, count(DISTINCT cat0) AS nr, count(DISTINCT cat1) AS nc FROM marg GROUP BY ALL),
    allr AS (SELECT DISTINCT src0, dst0, src1, dst1, cat0, r FROM marg), allc AS (SELECT DISTINCT src0, dst0, src1, dst1, cat1, c FROM marg),
    full_ AS (SELECT s.src0, s.dst0, s.src1, s.dst1, s.t, s.nr, s.nc, r.r * c.c / CAST(s.t AS DOUBLE) AS e, coalesce(m.n, 0) AS o FROM sizes s JOIN allr r USING (src0, dst0, src1, dst1)
      JOIN allc c USING (src0, dst0, src1, dst1) LEFT JOIN cells m ON m.src0 = s.src0 AND m.dst0 = s.dst0 AND m.src1 = s.src1 AND m.dst1 = s.dst1 AND m.cat0 = r.cat0 AND m.cat1 = c.cat1),
    chi AS (SELECT src0, dst0, src1, dst1, CAST(max(t) AS BIGINT) AS n, CASE WHEN max((nr - 1) * (nc - 1)) = 0 THEN 0.0 WHEN max((nr - 1) * (nc - 1)) = 1
      THEN sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) ELSE sum((o - e) ** 2 / e) END AS chi2, CAST(max((nr - 1) * (nc - 1)) AS INTEGER) AS dof FROM full_ GROUP BY ALL)""",
}
NEEDS = {"windows": ["lags"], "moments": ["lags", "windows"], "edges": ["lags", "windows", "moments"], "surrogate": ["lags", "jitter"], "pathways": ["membership"], "chi": ["membership", "pathways"]}


def sql_of(body: str, parts: tuple[str, ...]) -> str:
    from tidewell.functions.columns import sql_norm_cdf, sql_uniform

    wanted: list[str] = []
    for p in parts:
        wanted += [n for n in [*NEEDS.get(p, []), p] if n not in wanted]
    values = {
        "u_cell": sql_uniform("concat_ws('/', p.src, p.dst, x.trial_id, 0)"),
        "u_event": sql_uniform("concat_ws('/', p.unit_id, p.trial_id, p.t_us, r.rep, 0)"),
        "phi_z": sql_norm_cdf("z"),
    }
    texts = [adapters.BASE.strip()]
    for p in wanted:
        text = PARTS[p]
        for k, v in values.items():
            text = text.replace("{" + k + "}", v)
        texts.append(text)
    return "WITH " + ",\n".join(texts) + body


def query(name: str, sql: str | None = None, parts: tuple[str, ...] = ()):
    """Register ``f(tables) -> DataFrame``. ``sql`` goes on after the common tables: ', more AS (...) SELECT ...'."""
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql_of(sql, parts)
        return f

    return add


class Tables:
    """Inputs and intermediate tables of the queries, made when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        return adapters.points(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return adapters.points_raw(self.spark, self.sf_dir)

    @cached_property
    def units(self) -> DataFrame:
        return adapters.units(self.points)

    @cached_property
    def trials(self) -> DataFrame:
        return adapters.trials(self.points)

    @cached_property
    def frame(self) -> DataFrame:
        return binning.unit_trials(self.units, self.trials)

    @cached_property
    def counts(self) -> DataFrame:
        return binning.counts(self.points, self.frame)

    @cached_property
    def bins(self) -> DataFrame:
        return binning.bins(self.points, BIN)

    @cached_property
    def pairs(self) -> DataFrame:
        return pairs.unit_pairs(self.units, "between_probe")

    @cached_property
    def membership(self) -> DataFrame:
        return pairs.init_membership(self.pairs, self.counts)

    @cached_property
    def n_trials(self) -> int:
        return self.trials.count()

    @cached_property
    def edges(self) -> DataFrame:
        """A scored table of pairs: excess of coincidences at positive lags over the jitter mean, in closed form."""
        from tidewell.operators import ccg
        from tidewell.operators.testing import wald_p

        raw = ccg.ccg(self.bins, self.pairs, -LAGS, LAGS)
        moments = ccg.normal_moments(self.bins, self.pairs, -LAGS, LAGS, WINDOW_BINS)
        both = raw.join(moments, ["src", "dst", "lag"]).where("lag > 0").groupBy("src", "dst").agg((F.sum("raw") - F.sum("mean")).alias("h"), F.sum("var").alias("var")).where("var > 0")
        scored = both.select("src", "dst", wald_p(F.col("h"), F.sqrt("var")).alias("pval"), "h")
        return pairs.with_attributes(scored, self.units).withColumn("significant", F.col("pval") < 0.05)

    def pathway(self, a: str, b: str) -> DataFrame:
        return pairs.unit_pairs(self.units, probe_pairs=[(a, b)])

    @cached_property
    def cells(self) -> DataFrame:
        return pairs.shared_cells(self.membership, self.pathway("probeA", "probeB"), self.pathway("probeB", "probeC"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that another engine's order of summing makes no difference; -0.0 becomes 0.0."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


__all__ = ["QUERIES", "SQL", "Tables", "query", "rounded", "uniform"]
