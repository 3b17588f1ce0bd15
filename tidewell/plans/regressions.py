"""Queries: designs, fits, kernel widths, memberships, goodness of fit, and workflows."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import kernels, numeric
from tidewell.functions.columns import sql_norm_cdf, sql_uniform
from tidewell.operators import baselines, binning, design, fit, graph, multivariate, pairs, posterior, select, testing, trains
from tidewell.plans.basics import rates
from tidewell.plans.catalog import BIN, BINS, LENGTH, REPS, WIDTH, WINDOW_BINS, Tables, query, rounded
from tidewell.sources.adapters import DAY, HOUR

UNIT = float(HOUR)
HOURS = 24.0
COLUMNS = ["const", "nuisance", "filter"]
NORM = math.sqrt(2 * math.pi)
#: Kernel widths of 1, 2, 4 and 8 hours, in bins.
WIDTHS = [12.0, 24.0, 48.0, 96.0]



def integral(t: Tables) -> list[float]:
    """The integrals of the standard design: time, and 0 for columns with mean 0."""
    return [t.n_trials * HOURS, 0.0, 0.0]


TRAINS = ", tr AS (SELECT unit_id, trial_id, t_us, count(*) AS c FROM points GROUP BY ALL), yr AS (SELECT src, dst, trial_id, t_us AS y_us, c AS w FROM pairs JOIN tr ON tr.unit_id = dst)"


def around_sql(low: int, high: int, value: str, name: str) -> str:
    return f"""(SELECT p.src, p.dst, x.trial_id, y.t_us AS y_us, sum(CAST(({value}) AS DOUBLE) * x.c) AS {name} FROM pairs p JOIN tr x ON x.unit_id = p.src
 JOIN tr y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.t_us - x.t_us > {low} AND y.t_us - x.t_us <= {high} GROUP BY ALL)"""


D = "(y.t_us - x.t_us)"
REGRESSORS = {
    "k1_square": (around_sql(0, HOUR, "1.0", "v"), f"(SELECT unit_id AS src, sum({HOUR} - CASE WHEN t_us > {DAY - HOUR} THEN {HOUR} - ({DAY} - t_us) ELSE 0 END) / {UNIT} AS integral FROM points GROUP BY ALL)"),
    "k3_exponential": (around_sql(0, DAY, f"exp(-1.5 * {D} / {UNIT})", "v"), f"(SELECT unit_id AS src, sum((1 - exp(-1.5 * ({DAY} - t_us) / {UNIT})) / 1.5) AS integral FROM points GROUP BY ALL)"),
    "k6_square_kernel": (around_sql(-HOUR, HOUR, "0.5", "v"), f"(SELECT unit_id AS src, sum(1 - (greatest(0, {HOUR} - t_us) + greatest(0, {HOUR} - ({DAY} - t_us))) / {2 * HOUR}) AS integral FROM points GROUP BY ALL)"),
    "k7_triangle_kernel": (around_sql(-HOUR, HOUR, f"({HOUR} - abs({D})) / {UNIT}", "v"), f"""(SELECT unit_id AS src, sum(1 - CASE WHEN t_us < {HOUR} THEN (({HOUR} - t_us) / {UNIT}) ** 2 / 2 ELSE 0 END
   - CASE WHEN {DAY} - t_us < {HOUR} THEN (({HOUR} - ({DAY} - t_us)) / {UNIT}) ** 2 / 2 ELSE 0 END) AS integral FROM points GROUP BY ALL)"""),
    "k8_laplacian_kernel": (around_sql(-3 * WIDTH, 3 * WIDTH, f"exp(-abs({D} / {UNIT}) / {2 / 2**0.5!r}) / {2 * 2 / 2**0.5!r}", "v"), f"(SELECT unit_id AS src, count(*) * CAST({1 - math.exp(-3 * 2**0.5)!r} AS DOUBLE) AS integral FROM points GROUP BY ALL)"),
    "k9_gaussian_kernel": (around_sql(-5 * WIDTH, 5 * WIDTH, f"exp(-(({D} / {float(WIDTH)}) ** 2) / 2) / {2 * NORM!r}", "v"), f"""(SELECT unit_id AS src, sum(1 - 2 * {sql_norm_cdf("CAST(-5.0 AS DOUBLE)")}
   - CASE WHEN t_us <= {5 * WIDTH} THEN {sql_norm_cdf(f"(-t_us / {float(WIDTH)})")} ELSE 0 END - CASE WHEN {DAY} - t_us <= {5 * WIDTH} THEN {sql_norm_cdf(f"(-({DAY} - t_us) / {float(WIDTH)})")} ELSE 0 END) AS integral FROM points GROUP BY ALL)"""),
}


def regressor_sql(name: str) -> str:
    sums, integral = REGRESSORS[name]
    return TRAINS + f""", v AS {sums}, i AS {integral}, z AS (SELECT yr.src, yr.dst, yr.w, coalesce(v, 0)::DOUBLE AS v FROM yr LEFT JOIN v USING (src, dst, trial_id, y_us))
SELECT src, dst, CAST(sum(w) AS BIGINT) AS n_y, round(sum(w * v), 5) AS s1, round(sum(w * v * v), 5) AS s2, round(max(integral), 5) AS integral FROM z JOIN i USING (src) GROUP BY src, dst"""


def summed(t: Tables, rows: DataFrame, area: DataFrame) -> DataFrame:
    """A regressor over every y event of every pair, as its first two moments, and its integral."""
    w, v = F.col("w"), F.col(rows.columns[-1])
    out = rows.groupBy("src", "dst").agg(F.sum(w).alias("n_y"), F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2")).join(area, "src")
    return rounded(out.select("src", "dst", "n_y", "s1", "s2", "integral"), "s1", "s2", "integral", digits=5)


@query("k1_square", regressor_sql("k1_square"))
def k1(t: Tables) -> DataFrame:
    return summed(t, *design.square(t.points, t.pairs, HOUR, DAY, UNIT))


@query("k2_bspline")
def k2(t: Tables) -> DataFrame:
    inner = (numeric.knots(6, 1.0)).tolist()
    return design.bspline_filter(t.points, t.pairs, inner, HOUR)


@query("k3_exponential", regressor_sql("k3_exponential"))
def k3(t: Tables) -> DataFrame:
    return summed(t, *design.exponential(t.points, t.pairs, 1.5, DAY, UNIT))


@query("k3_exponential_slope", TRAINS + f""", v AS {around_sql(0, DAY, f"-({D} / {UNIT}) * exp(-1.5 * {D} / {UNIT})", "v")} SELECT src, dst, round(sum(v), 5) AS s FROM v GROUP BY ALL""")
def k3b(t: Tables) -> DataFrame:
    slopes = design.exponential_slope(t.points, t.pairs, 1.5, DAY, UNIT).where("slope < 0")
    return rounded(slopes.groupBy("src", "dst").agg(F.sum("slope").alias("s")), "s", digits=5)


@query("k4_constant", TRAINS + f" SELECT src, dst, CAST(sum(w) AS BIGINT) AS n_y, CAST(24.0 * (SELECT count(*) FROM trials) AS DOUBLE) AS integral FROM yr GROUP BY ALL")
def k4(t: Tables) -> DataFrame:
    return design.y_rows(t.points, t.pairs).groupBy("src", "dst").agg(F.sum("w").alias("n_y"), F.first(F.lit(t.n_trials * HOURS)).alias("integral"))


@query("k4_trial_blocks")
def k4b(t: Tables) -> DataFrame:
    return baselines.fit_baselines(standard(t), HOURS)


@query("k5_jitter_mean", TRAINS + """, xw AS (SELECT unit_id AS src, trial_id, t_us // 14400000000 AS win, count(*) AS n FROM points GROUP BY ALL)
SELECT src, dst, round(sum(n / 4.0), 6) AS s1, round(sum((n / 4.0) ** 2), 6) AS s2 FROM yr JOIN xw ON xw.src = yr.src AND xw.trial_id = yr.trial_id AND xw.win = yr.y_us // 14400000000 GROUP BY yr.src, dst""".replace("SELECT src, dst, round", "SELECT yr.src, dst, round"))
def k5(t: Tables) -> DataFrame:
    v = F.col("jitter_mean")
    return rounded(design.jitter_mean(t.points, t.pairs, 4 * HOUR, UNIT).where("jitter_mean > 0").groupBy("src", "dst").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("s2")), "s1", "s2")


@query("k6_square_kernel", regressor_sql("k6_square_kernel"))
def k6(t: Tables) -> DataFrame:
    return summed(t, *design.square_kernel(t.points, t.pairs, 2 * HOUR, DAY, UNIT))


@query("k7_triangle_kernel", regressor_sql("k7_triangle_kernel"))
def k7(t: Tables) -> DataFrame:
    return summed(t, *design.triangle_kernel(t.points, t.pairs, 2 * HOUR, DAY, UNIT))


@query("k8_laplacian_kernel", regressor_sql("k8_laplacian_kernel"))
def k8(t: Tables) -> DataFrame:
    return summed(t, *design.laplacian_kernel(t.points, t.pairs, WIDTH, UNIT))


@query("k9_gaussian_kernel", regressor_sql("k9_gaussian_kernel"))
def k9(t: Tables) -> DataFrame:
    return summed(t, *design.gaussian_kernel(t.points, t.pairs, WIDTH, DAY, UNIT))


def standard(t: Tables, self_coupling: bool = False) -> DataFrame:
    return design.standard_design(t.points, t.pairs, t.n_trials, DAY, LENGTH, WIDTH, UNIT, self_coupling)


DESIGN = TRAINS + f""", v1 AS {REGRESSORS["k9_gaussian_kernel"][0]}, i1 AS {REGRESSORS["k9_gaussian_kernel"][1]}, v2 AS {REGRESSORS["k1_square"][0]}, i2 AS {REGRESSORS["k1_square"][1]},
dz AS (SELECT yr.src, yr.dst, yr.trial_id, yr.y_us, yr.w, coalesce(v1.v, 0) - i1.integral / (24.0 * (SELECT count(*) FROM trials)) AS nuisance, coalesce(v2.v, 0) - i2.integral / (24.0 * (SELECT count(*) FROM trials)) AS filter FROM yr
 LEFT JOIN v1 USING (src, dst, trial_id, y_us) LEFT JOIN v2 USING (src, dst, trial_id, y_us) JOIN i1 ON i1.src = yr.src JOIN i2 ON i2.src = yr.src)"""


@query("k10_design", DESIGN + " SELECT src, dst, count(*) AS n, round(sum(w * nuisance), 5) AS s_n, round(sum(w * filter), 5) AS s_f, round(sum(w * nuisance * filter), 5) AS s_nf FROM dz GROUP BY ALL")
def k10(t: Tables) -> DataFrame:
    w, n, f = F.col("w"), F.col("nuisance"), F.col("filter")
    return rounded(standard(t).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum(w * n).alias("s_n"), F.sum(w * f).alias("s_f"), F.sum(w * n * f).alias("s_nf")), "s_n", "s_f", "s_nf", digits=5)


@query("k10_self_coupling")
def k10b(t: Tables) -> DataFrame:
    return standard(t, True).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("own").alias("s_own"))


def fitted(t: Tables) -> DataFrame:
    return fit.standard_fits(t.points, t.pairs, t.n_trials, DAY, LENGTH, [WIDTH], UNIT).drop("width")


@query("k11_fit")
def k11(t: Tables) -> DataFrame:
    return fitted(t).select("src", "dst", "beta", "nll", "n_iter", "converged", "note")


#: A fit is the point at which the gradient is 0, which SQL can state without fitting. There is none where all y events
#: lie in one half of the plane of nuisance and filter: some gap between their directions is then over half a turn.
@query("k11_gradient", DESIGN + """, an AS (SELECT src, dst, atan2(filter, nuisance) AS a FROM dz), gp AS (SELECT src, dst, a - lag(a) OVER (PARTITION BY src, dst ORDER BY a) AS g, a FROM an)
SELECT src, dst, greatest(coalesce(max(g), 0), 2 * pi() - max(a) + min(a)) < pi() AS converged, 0.0::DOUBLE AS g0, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2 FROM gp GROUP BY ALL""")
def k11b(t: Tables) -> DataFrame:
    """Which fits converge, and their gradients, from rows that joins and sums evaluate, as shares of their terms."""
    d, fits = standard(t), fit.settle(fitted(t))
    g = fit.gradient_at(d, ["src", "dst"], COLUMNS, fits.select("src", "dst", "beta"), integral(t))
    scale = d.groupBy("src", "dst").agg(*[F.sum(F.col("w") * F.abs(c)).alias(f"a{i}") for i, c in enumerate(COLUMNS)])
    both = fits.join(g, ["src", "dst"], "left").join(scale, ["src", "dst"])
    share = lambda i: F.when(F.col("converged"), F.col(f"g{i}") / (1 + F.col(f"a{i}"))).otherwise(0.0)
    return rounded(both.select("src", "dst", "converged", *[share(i).alias(f"g{i}") for i in range(3)]), "g0", "g1", "g2", digits=4)


def group_heights() -> dict[int, float]:
    return {0: 0.0, 1: 0.1, 2: -0.02, 3: 0.2, 4: 0.05}


def grouped_design(t: Tables) -> DataFrame:
    cells = t.membership.where("group_id is not null").select("src", "dst", "trial_id", "group_id")
    return standard(t).join(cells, ["src", "dst", "trial_id"])


def grouped_blocks(t: Tables, membership: DataFrame) -> DataFrame:
    """The same in blocks, for fits of many rows."""
    named, known = design.standard_columns(t.points, t.pairs, t.n_trials, DAY, LENGTH, [WIDTH], UNIT)
    return trains.blocks(t.points, known, named, membership.where("group_id is not null").select("src", "dst", "trial_id", "group_id"))


def group_fits(t: Tables, *keys: str, **options) -> DataFrame:
    return fit.pooled_blocks(grouped_blocks(t, t.membership), list(keys), len(COLUMNS), group_totals(t, *keys), **options)


def group_totals(t: Tables, *keys: str) -> DataFrame:
    """(keys, total): the integrals of a pooled model, from the number of cells that it holds."""
    cells = t.membership.where("group_id is not null").groupBy(*keys).agg(F.count("*").alias("cells"))
    return cells.select(*keys, F.array(F.col("cells") * HOURS, F.lit(0.0), F.lit(0.0)).alias("total"))


@query("k12_pooled_fit")
def k12(t: Tables) -> DataFrame:
    """One model a group over all its cells: every step is one aggregation for all five."""
    fits = group_fits(t, "group_id")
    return fits.select("group_id", "beta", "nll", "n_iter", "converged", "note")


#: As for the fits of pairs: which models have a best fit follows from the directions of their rows, and there the gradient is 0.
@query("k12_pooled_gradient", DESIGN + """, gz AS (SELECT group_id, nuisance, filter FROM dz JOIN membership USING (src, dst, trial_id) WHERE group_id IS NOT NULL),
an AS (SELECT group_id, atan2(filter, nuisance) AS a FROM gz), gp AS (SELECT group_id, a - lag(a) OVER (PARTITION BY group_id ORDER BY a) AS g, a FROM an)
SELECT group_id, greatest(coalesce(max(g), 0), 2 * pi() - max(a) + min(a)) < pi() AS converged, 0.0::DOUBLE AS g0, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2 FROM gp GROUP BY ALL""", ("membership",))
def k12b(t: Tables) -> DataFrame:
    d, totals = grouped_design(t), group_totals(t, "group_id")
    fits = group_fits(t, "group_id")
    g = fit.gradient_at(d, ["group_id"], COLUMNS, fits.select("group_id", "beta"), [0.0, 0.0, 0.0]).join(totals, "group_id")
    scale = d.groupBy("group_id").agg(*[F.sum(F.col("w") * F.abs(c)).alias(f"a{i}") for i, c in enumerate(COLUMNS)])
    both = fits.select("group_id", "converged").join(g, "group_id", "left").join(scale, "group_id")
    share = lambda i: F.when(F.col("converged"), (F.col(f"g{i}") + F.col("total")[i]) / (1 + F.col(f"a{i}"))).otherwise(0.0)
    return rounded(both.select("group_id", "converged", *[share(i).alias(f"g{i}") for i in range(3)]), "g0", "g1", "g2", digits=6)


@query("k12_trial_group_fits")
def k12c(t: Tables) -> DataFrame:
    """A model for every trial and group."""
    keys = ["trial_id", "group_id"]
    return group_fits(t, *keys).select(*keys, "beta", "nll", "n_iter", "converged", "note")


@query("k12_pair_group_fits")
def k12d(t: Tables) -> DataFrame:
    """A model for every pair and group."""
    keys = ["src", "dst", "group_id"]
    return group_fits(t, *keys).select(*keys, "beta", "nll", "n_iter", "converged", "note")


@query("k13_batch_fit")
def k13(t: Tables) -> DataFrame:
    """Half of the trials a step; a fit ends when the mean nll of its batches changes by less than a share of 1e-3."""
    fits = group_fits(t, "group_id", batch=fit.trial_batch(0.5), flat=1e-3)
    return fits.select("group_id", "beta", "nll", "n_iter", "converged", "note")


@query("k14_surrogate_fits")
def k14(t: Tables) -> DataFrame:
    """The filter's height of every pair (rep 0), and with x moved in its windows, REPS times."""
    return trains.surrogate_fits(t.points, t.pairs, 4 * HOUR, REPS, t.n_trials, DAY, LENGTH, WIDTH, UNIT)


@query("k15_exponential_fit")
def k15(t: Tables) -> DataFrame:
    return fit.fit_exponential(t.points, t.pairs, DAY, UNIT, t.n_trials)


@query("k16_multivariate_fit")
def k16(t: Tables) -> DataFrame:
    area = integral(t)[0]
    sums = design.square_integral(t.points, LENGTH, DAY, UNIT).select("src", F.array(F.col("integral") / area).alias("means"))
    return multivariate.fit_trains(t.points, t.pairs.join(sums, "src"), {"filter": trains.square_filter(LENGTH)}, [area, 0.0])


@query("k17_nll", DESIGN + f""", b AS (SELECT dst, sum(w) / (24.0 * (SELECT count(*) FROM trials)) AS b0 FROM (SELECT DISTINCT dst, trial_id, y_us, w FROM yr) GROUP BY ALL)
SELECT src, dst, round(-sum(w * ln(b0 + 0.01 * nuisance + 0.005 * filter)) + max(b0) * 24 * (SELECT count(*) FROM trials), 4) AS nll FROM dz JOIN b USING (dst) WHERE b0 + 0.01 * nuisance + 0.005 * filter > 0 GROUP BY ALL""")
def k17(t: Tables) -> DataFrame:
    d = standard(t)
    beta = d.groupBy("src", "dst").agg(F.array(F.sum("w") / integral(t)[0], F.lit(0.01), F.lit(0.005)).alias("beta"))
    return rounded(fit.nll_at(d, ["src", "dst"], COLUMNS, beta, integral(t)), "nll", digits=4)


@query("k18_posterior")
def k18(t: Tables) -> DataFrame:
    """Posterior of every pair's coefficients and kernel width (hours), from 1 to 8 hours."""
    return posterior.standard_posterior(t.points, t.pairs, t.n_trials, DAY, LENGTH, [int(w) * BIN for w in WIDTHS], UNIT, HOUR, samples=1000)


@query("k18_posterior_fixed_width")
def k18b(t: Tables) -> DataFrame:
    """The same with the kernel width of two hours held fixed."""
    return posterior.standard_posterior(t.points, t.pairs, t.n_trials, DAY, LENGTH, [WIDTH], UNIT, HOUR, samples=1000)


@query("k19_filters")
def k19(t: Tables) -> DataFrame:
    """Filters on a grid with standard errors, from fits whose covariance is the inverse Hessian."""
    @F.pandas_udf("array<array<double>>")
    def inverse(hessian: pd.Series) -> pd.Series:
        return hessian.map(lambda h: np.linalg.pinv(np.array([list(r) for r in h])).tolist())

    fits = fitted(t).where("converged").withColumn("cov", inverse("hessian"))
    return fit.reconstruct(fits, [[0.0, 0.0, 1.0 if i < 12 else 0.0] for i in range(24)])


CONV = f""", gk AS (SELECT CAST(w AS DOUBLE) AS width, o AS off, exp(-((o / w) ** 2) / 2) / {NORM!r} / w AS wt FROM (SELECT unnest([12.0, 24.0, 48.0, 96.0]) AS w) CROSS JOIN range(-480, 481) r(o) WHERE abs(o) <= round(5 * w)),
cw AS (SELECT unit_id, trial_id, width, bin + off AS bin, sum(n * wt) AS w FROM bins CROSS JOIN gk WHERE bin + off BETWEEN 0 AND 287 GROUP BY ALL),
ch AS (SELECT unit_id, trial_id, bin + off AS bin, CAST(sum(n) AS DOUBLE) AS h FROM bins CROSS JOIN range(1, 13) r(off) WHERE bin + off BETWEEN 0 AND 287 GROUP BY ALL)"""


@query("k20_discrete_square", CONV + " SELECT unit_id, trial_id, bin, h AS value FROM ch")
def k20(t: Tables) -> DataFrame:
    return design.convolve(t.bins, {0: design.square_bins(12)}, BINS)


@query("k20_discrete_gaussian", CONV + " SELECT unit_id, width, round(sum(w), 5) AS s1, round(sum(w * w), 5) AS s2 FROM cw GROUP BY ALL")
def k20b(t: Tables) -> DataFrame:
    w = design.convolve(t.bins, {w: design.gaussian_bins(w) for w in WIDTHS}, BINS, "width")
    return rounded(w.groupBy("unit_id", "width").agg(F.sum("value").alias("s1"), F.sum(F.col("value") ** 2).alias("s2")), "s1", "s2", digits=5)


@query("k20_discrete_triangle", " SELECT unit_id, trial_id, bin + o AS bin, round(sum(n * (12 - abs(o)) / 144.0), 6) AS value FROM bins CROSS JOIN range(-12, 13) r(o) WHERE bin + o BETWEEN 0 AND 287 GROUP BY ALL")
def k20c(t: Tables) -> DataFrame:
    return rounded(design.convolve(t.bins, {0: design.triangle_bins(12)}, BINS), "value")


@query("k20_discrete_bspline")
def k20d(t: Tables) -> DataFrame:
    basis = numeric.bspline(numeric.knots(6, 1.0), (np.arange(1, 13)) / 12)[:, :-1]
    sums = design.convolve(t.bins, {k: (1, row) for k, row in enumerate(basis.T)}, BINS, "basis")
    return sums.groupBy("unit_id", F.col("basis").cast("int").alias("basis")).agg(F.sum("value").alias("s"))


@query("k20_discrete_self_coupling", CONV + """, mo AS (SELECT unit_id, sum(h) / (288.0 * (SELECT count(*) FROM trials)) AS m FROM ch GROUP BY ALL)
SELECT b.unit_id AS dst, CAST(count(*) AS BIGINT) AS n_bins, round(sum(b.n * (coalesce(h, 0) - m)), 7) AS s_own FROM bins b LEFT JOIN ch USING (unit_id, trial_id, bin) JOIN mo ON mo.unit_id = b.unit_id GROUP BY ALL""")
def k20e(t: Tables) -> DataFrame:
    """y's coupling to itself on bins, summed over its events."""
    own = design.own_bins(t.bins, 12, BINS, t.n_trials)
    mean = own.groupBy("dst").agg(F.first("mean").alias("mean"))
    y = t.bins.withColumnRenamed("unit_id", "dst").join(own.select("dst", "trial_id", "bin", "own"), ["dst", "trial_id", "bin"], "left").join(mean, "dst")
    value = F.coalesce("own", -F.col("mean"))
    return rounded(y.groupBy("dst").agg(F.count("*").alias("n_bins"), F.sum(F.col("n") * value).alias("s_own")), "s_own", digits=7)


GRAM = CONV + """, ow AS (SELECT unit_id, width, sum(w) AS sw, sum(w * w) AS sww FROM cw GROUP BY ALL), oh AS (SELECT unit_id, sum(h) AS sh, sum(h * h) AS shh FROM ch GROUP BY ALL),
owh AS (SELECT cw.unit_id, width, sum(w * h) AS swh FROM cw JOIN ch USING (unit_id, trial_id, bin) GROUP BY ALL), sy AS (SELECT unit_id AS dst, sum(n) AS s_y FROM bins GROUP BY ALL),
wy AS (SELECT p.src, p.dst, width, sum(w * y.n) AS swy FROM pairs p JOIN cw ON cw.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = cw.trial_id AND y.bin = cw.bin GROUP BY ALL),
hy AS (SELECT p.src, p.dst, sum(h * y.n) AS shy FROM pairs p JOIN ch ON ch.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = ch.trial_id AND y.bin = ch.bin GROUP BY ALL),
gram AS (SELECT p.src, p.dst, ow.width, sww - sw * sw / (288.0 * (SELECT count(*) FROM trials)) AS ww, coalesce(swh, 0) - sw * sh / (288.0 * (SELECT count(*) FROM trials)) AS wh, shh - sh * sh / (288.0 * (SELECT count(*) FROM trials)) AS hh, coalesce(swy, 0) - sw * s_y / (288.0 * (SELECT count(*) FROM trials)) AS wy, coalesce(shy, 0) - sh * s_y / (288.0 * (SELECT count(*) FROM trials)) AS hy, s_y
 FROM pairs p JOIN ow ON ow.unit_id = p.src JOIN oh ON oh.unit_id = p.src LEFT JOIN owh ON owh.unit_id = p.src AND owh.width = ow.width JOIN sy ON sy.dst = p.dst LEFT JOIN wy ON wy.src = p.src AND wy.dst = p.dst AND wy.width = ow.width LEFT JOIN hy ON hy.src = p.src AND hy.dst = p.dst),
curve AS (SELECT *, (wy * wy * hh - 2 * wy * hy * wh + hy * hy * ww) / (ww * hh - wh * wh) / (2 * s_y / (288.0 * (SELECT count(*) FROM trials))) AS value, wy * wy / ww / (2 * s_y / (288.0 * (SELECT count(*) FROM trials))) AS simple FROM gram)"""


def gram(t: Tables) -> DataFrame:
    return design.gram(t.bins, t.pairs, WIDTHS, 12, BINS, t.n_trials)


@query("k22_gram", GRAM + " SELECT src, dst, width, round(ww, 4) AS s_ww, round(wh, 4) AS s_wh, round(hh, 4) AS s_hh, round(wy, 4) AS s_wy, round(hy, 4) AS s_hy FROM gram")
def k22(t: Tables) -> DataFrame:
    return rounded(gram(t).drop("s_y"), "s_ww", "s_wh", "s_hh", "s_wy", "s_hy", digits=4)


@query("k21_l2_fit", GRAM + " SELECT src, dst, width, round(s_y / (288.0 * (SELECT count(*) FROM trials)), 6) AS beta0, round((wy * hh - hy * wh) / (ww * hh - wh * wh), 6) AS beta_w, round((hy * ww - wy * wh) / (ww * hh - wh * wh), 6) AS beta_h FROM gram")
def k21(t: Tables) -> DataFrame:
    return rounded(design.l2_fit(gram(t), BINS, t.n_trials), "beta0", "beta_w", "beta_h")


@query("k21_no_coupling", GRAM + " SELECT src, dst, width, round(wy / ww, 6) AS slope FROM gram")
def k21b(t: Tables) -> DataFrame:
    return rounded(design.l2_no_coupling(gram(t)), "slope")


@query("k21_discrete_fit")
def k21c(t: Tables) -> DataFrame:
    """The likelihood fit in binned time: rows are y's bins with events."""
    w = design.convolve(t.bins, {0: design.gaussian_bins(24.0)}, BINS).select(F.col("unit_id").alias("src"), "trial_id", "bin", F.col("value").alias("nuisance"))
    h = design.convolve(t.bins, {0: design.square_bins(12)}, BINS).select(F.col("unit_id").alias("src"), "trial_id", "bin", F.col("value").alias("filter"))
    total = w.groupBy("src").agg((F.sum("nuisance") / (BINS * t.n_trials)).alias("mw")).join(h.groupBy("src").agg((F.sum("filter") / (BINS * t.n_trials)).alias("mh")), "src")
    y = t.bins.select(F.col("unit_id").alias("dst"), "trial_id", "bin", F.col("n").alias("w")).join(t.pairs, "dst")
    d = y.join(w, ["src", "trial_id", "bin"], "left").join(h, ["src", "trial_id", "bin"], "left").join(total, "src").select(
        "src", "dst", "w", F.lit(1.0).alias("const"), (F.coalesce("nuisance", F.lit(0.0)) - F.col("mw")).alias("nuisance"), (F.coalesce("filter", F.lit(0.0)) - F.col("mh")).alias("filter")
    )
    return fit.fit_by_key(d, ["src", "dst"], COLUMNS, [BINS * t.n_trials, 0.0, 0.0]).select("src", "dst", "beta", "nll", "converged")


@query("k23_width_curve", GRAM + " SELECT src, dst, width, round(value - max(value) OVER (PARTITION BY src, dst), 6) AS gain FROM curve")
def k23(t: Tables) -> DataFrame:
    return rounded(design.width_curve(gram(t), BINS, t.n_trials), "gain")


@query("k23_best_width", GRAM + " SELECT src, dst, arg_max(width, (simple, -width)) AS width FROM curve GROUP BY ALL")
def k23b(t: Tables) -> DataFrame:
    return design.best_width(design.width_curve(gram(t), BINS, t.n_trials, simple=True))


def refits(t: Tables, self_coupling: bool) -> DataFrame:
    """(src, dst, width): the width with the least negative log-likelihood of the full fit.

    All widths' regressors are made at once, in the task that fits the pair.
    """
    fits = fit.standard_fits(t.points, t.pairs, t.n_trials, DAY, LENGTH, [int(w) * BIN for w in WIDTHS], UNIT, self_coupling)
    return fits.groupBy("src", "dst").agg(F.min_by(F.col("width") / HOUR, F.struct("nll", "width")).alias("width"))


@query("k23_width_by_refit")
def k23c(t: Tables) -> DataFrame:
    return refits(t, False)


@query("k23_width_by_self_refit")
def k23d(t: Tables) -> DataFrame:
    """The same with y's coupling to itself in the model."""
    return refits(t, True)


@query("k24_init_membership", " SELECT src, dst, trial_id, group_id FROM membership", ("membership",))
def k24(t: Tables) -> DataFrame:
    return t.membership


def member_nlls(t: Tables, heights: dict[int, float], shares: dict[int, float], drive: DataFrame | None = None) -> DataFrame:
    return fit.standard_membership_nlls(t.points, t.pairs, t.n_trials, DAY, LENGTH, WIDTH, UNIT, heights, shares, drive)


def scores(t: Tables) -> DataFrame:
    shares = {r.group_id: r.portion for r in fit.portions(t.membership).collect()}
    return member_nlls(t, group_heights(), shares)


@query("k25_update_membership")
def k25(t: Tables) -> DataFrame:
    return fit.update_membership(t.pairs, scores(t))


@query("k25_sample_membership")
def k25b(t: Tables) -> DataFrame:
    return fit.update_membership(t.pairs, scores(t), sample=True)


@query("k26_update_with_drivers")
def k26(t: Tables) -> DataFrame:
    """As k25, with every unit of y's probe as an extra slow source: their summed activity is the nuisance."""
    others = t.units.select(F.col("unit_id").alias("dst"), "probe").join(t.units.select(F.col("unit_id").alias("other"), "probe"), "probe").where("dst <> other").select(F.col("other").alias("src"), "dst")
    shares = {r.group_id: r.portion for r in fit.portions(t.membership).collect()}
    best = fit.update_membership(t.pairs, member_nlls(t, group_heights(), shares, design.drives(t.points, others, t.n_trials, DAY, WIDTH, UNIT)))
    return best.withColumn("group_id", F.coalesce("group_id", F.lit(0)))


RESCALE = f"""{GRAM}, fits AS (SELECT src, dst, s_y / (288.0 * (SELECT count(*) FROM trials)) AS b0, coalesce((wy * hh - hy * wh) / CASE WHEN abs(ww * hh - wh * wh) > 1e-9 THEN ww * hh - wh * wh END, 0) AS bw,
 coalesce((hy * ww - wy * wh) / CASE WHEN abs(ww * hh - wh * wh) > 1e-9 THEN ww * hh - wh * wh END, 0) AS bh FROM gram WHERE width = 24),
mh AS (SELECT unit_id AS src, sum(h) / (288.0 * (SELECT count(*) FROM trials)) AS mh FROM ch GROUP BY ALL), mw AS (SELECT unit_id AS src, sum(w) / (288.0 * (SELECT count(*) FROM trials)) AS mw FROM cw WHERE width = 24 GROUP BY ALL),
lam AS (SELECT p.src, p.dst, t.trial_id, CAST(k AS BIGINT) AS bin, greatest(b0 + bw * (coalesce(w, 0) - mw) + bh * (coalesce(h, 0) - mh), 1e-6) AS lam FROM fits p JOIN mh USING (src) JOIN mw USING (src) CROSS JOIN trials t CROSS JOIN range(0, 288) r(k)
 LEFT JOIN ch ON ch.unit_id = p.src AND ch.trial_id = t.trial_id AND ch.bin = k LEFT JOIN cw ON cw.unit_id = p.src AND cw.trial_id = t.trial_id AND cw.bin = k AND cw.width = 24),
cum AS (SELECT *, sum(lam) OVER (PARTITION BY src, dst, trial_id ORDER BY bin) AS area FROM lam),
ev AS (SELECT c.src, c.dst, c.trial_id, t_us, lam, area, lag(area) OVER (PARTITION BY c.src, c.dst, c.trial_id ORDER BY t_us) AS before, {sql_uniform("concat_ws('/', c.src, c.dst, c.trial_id, t_us, 0)")} AS r
 FROM cum c JOIN (SELECT DISTINCT unit_id, trial_id, t_us FROM points) p ON p.unit_id = c.dst AND p.trial_id = c.trial_id AND p.t_us // {BIN} = c.bin),
us AS (SELECT src, dst, trial_id, t_us, 1 - exp(-least(greatest(area - lam - before, 0) - ln(1 - r * (1 - exp(-lam))), 10)) AS u FROM ev WHERE before IS NOT NULL)"""


def rescaled(t: Tables) -> DataFrame:
    """Every pair's events against its own least-squares fit: background at a width of two hours, and the square filter.

    The intensity has a row for every pair, trial and bin, as rescaling integrates it between events.
    """
    per = lambda kernel, name: design.convolve(t.bins, {0: kernel}, BINS).select(F.col("unit_id").alias("src"), "trial_id", "bin", F.col("value").alias(name))
    h, w = per(design.square_bins(12), "h"), per(design.gaussian_bins(24.0), "w")
    mean = lambda d, name: d.groupBy("src").agg((F.sum(name) / (BINS * t.n_trials)).alias(f"m{name}"))
    fits = design.l2_fit(gram(t), BINS, t.n_trials).where("width = 24").select("src", "dst", "beta0", F.coalesce("beta_w", F.lit(0.0)).alias("bw"), F.coalesce("beta_h", F.lit(0.0)).alias("bh"))
    smooth = w.join(h, ["src", "trial_id", "bin"], "left")  # a square filter's bins lie within the Gaussian's
    frame = t.units.select(F.col("unit_id").alias("src")).join(t.trials.select("trial_id"))
    dense = binning.dense(smooth, frame, BINS, "w").fillna(0.0, ["h"])
    every = fits.join(mean(h, "h"), "src").join(mean(w, "w"), "src").join(dense, "src")
    lam = F.greatest(F.col("beta0") + F.col("bw") * (F.col("w") - F.col("mw")) + F.col("bh") * (F.col("h") - F.col("mh")), F.lit(1e-6))
    events = t.points.distinct().withColumnRenamed("unit_id", "dst").join(t.pairs, "dst").select("src", "dst", "trial_id", "t_us", F.floor(F.col("t_us") / BIN).alias("bin"))
    return fit.time_rescaling(events, every.select("src", "dst", "trial_id", "bin", lam.alias("lam")), ("src", "dst"))


@query("k27_time_rescaling", RESCALE + " SELECT src, dst, trial_id, t_us, round(u, 6) AS u FROM us")
def k27(t: Tables) -> DataFrame:
    return rounded(rescaled(t), "u")


@query("k28_ks_band", RESCALE + """, g AS (SELECT CAST(i AS INTEGER) AS bin, i / 20.0 AS q FROM range(1, 21) r(i)), c AS (SELECT src, dst, bin, q, count(*) FILTER (round(u, 9) <= q) / count(*) AS e, sqrt(-ln(0.025) / 2) / sqrt(count(*)) AS band FROM us CROSS JOIN g GROUP BY ALL)
SELECT src, dst, count(*) FILTER (abs(e - q) > band) AS outside FROM c GROUP BY ALL""")
def k28(t: Tables) -> DataFrame:
    return testing.ks_outside(rounded(rescaled(t), "u", digits=9), 20, ("src", "dst"))


NULL_GRID = "nt AS (SELECT bin / 40.0 AS q, count(*) FILTER (round(u, 9) <= bin / 40.0) / CAST(count(*) AS DOUBLE) AS cdf FROM us CROSS JOIN range(0, 41) r(bin) GROUP BY bin)"


@query("k28_ks_null_table", f"""{RESCALE}, {NULL_GRID}, g AS (SELECT CAST(i AS INTEGER) AS bin, i / 25.0 AS q FROM range(1, 26) r(i)),
m AS (SELECT bin, g.q, max(nt.q) FILTER (nt.q <= g.q) AS q0, min(nt.q) FILTER (nt.q >= g.q) AS q1 FROM g CROSS JOIN nt GROUP BY ALL),
k AS (SELECT bin, m.q, a.cdf + CASE WHEN q1 > q0 THEN (m.q - q0) / (q1 - q0) * (b.cdf - a.cdf) ELSE 0 END AS model FROM m JOIN nt a ON a.q = q0 JOIN nt b ON b.q = q1),
c AS (SELECT src, dst, bin, model, count(*) FILTER (round(u, 9) <= q) / count(*) AS e, sqrt(-ln(0.025) / 2) / sqrt(count(*)) AS band FROM us CROSS JOIN k GROUP BY ALL)
SELECT src, dst, count(*) FILTER (abs(e - model) > band + 1e-12) AS outside FROM c GROUP BY ALL""")
def k28b(t: Tables) -> DataFrame:
    """Each pair against the distribution of all pairs' values, which is a table on another grid."""
    u = fit.settle(rounded(rescaled(t), "u", digits=9))
    null = testing.ecdf(u, 40, (), "u").select("q", F.col("ecdf").alias("cdf"))
    return testing.ks_outside(u, 25, ("src", "dst"), null=null)


def kernel_sql(kind: str) -> str:
    e = f"(({D}) / {UNIT} - 0.25)"
    value = {"square": "1.0", "triangle": f"1 - {e} / 0.5", "inverse_triangle": f"{e} / 0.5"}[kind]
    return f"CASE WHEN {e} > 0 AND {e} <= 0.5 THEN {value} ELSE 0 END"


@query("k29_intensity", TRAINS + f""", iv AS {around_sql(0, HOUR, kernel_sql("square"), "sq")}, it AS {around_sql(0, HOUR, kernel_sql("triangle"), "tri")}, ii AS {around_sql(0, HOUR, kernel_sql("inverse_triangle"), "inv")}, ie AS {around_sql(0, DAY, f"exp(-{D} / {UNIT} / 0.5)", "ex")}
SELECT yr.src, yr.dst, round(sum(2 + 0.5 * coalesce(sq, 0)), 5) AS square, round(sum(2 + 0.5 * coalesce(tri, 0)), 5) AS triangle, round(sum(2 + 0.5 * coalesce(inv, 0)), 5) AS inverse_triangle, round(sum(2 + 0.5 * coalesce(ex, 0)), 5) AS exponential
FROM yr LEFT JOIN iv USING (src, dst, trial_id, y_us) LEFT JOIN it USING (src, dst, trial_id, y_us) LEFT JOIN ii USING (src, dst, trial_id, y_us) LEFT JOIN ie USING (src, dst, trial_id, y_us) GROUP BY yr.src, yr.dst""")
def k29(t: Tables) -> DataFrame:
    """Summed intensity 2 + 0.5 g at every y event: kernels of half an hour, a quarter of an hour late; the exponential at once."""
    low, high = HOUR // 4, HOUR // 4 + HOUR // 2
    named = {
        "square": partial(kernels.count, low=low, high=high), "triangle": partial(kernels.ramp, low=low, high=high, rising=False),
        "inverse_triangle": partial(kernels.ramp, low=low, high=high, rising=True), "exponential": partial(kernels.exponential, rate=2.0, unit=UNIT),
    }
    out = trains.regressors(t.points, t.pairs, named)
    kinds = tuple(named)
    out = out.withColumns({k: 2 + 0.5 * F.col(k) for k in kinds})
    return rounded(out.groupBy("src", "dst").agg(*[F.sum(k).alias(k) for k in kinds]), *kinds, digits=5)


BUMPS = {"gaussian": f"exp(-d * d / (2 * sg * sg)) / (sg * {NORM!r})", "laplacian": "exp(-abs(d) / sg) / (2 * sg)"}


@query("k30_background", f""", pk AS (SELECT trial_id, t_us / {UNIT} AS pk, 0.5 + unit_id * 0.01 AS sg FROM points), gr AS (SELECT trial_id, h * 0.5 AS tt FROM trials CROSS JOIN range(0, 48) r(h)),
met AS (SELECT gr.trial_id, tt, CAST(tt - pk AS DOUBLE) AS d, CAST(sg AS DOUBLE) AS sg FROM gr LEFT JOIN pk ON pk.trial_id = gr.trial_id AND abs(tt - pk) <= 2)
SELECT trial_id, CAST(tt AS DOUBLE) AS t, round(1 + coalesce(sum({BUMPS["gaussian"]}), 0), 6) AS gaussian, round(1 + coalesce(sum({BUMPS["laplacian"]}), 0), 6) AS laplacian, round(CAST(30 + 5 * sin(2 * pi() * 0.25 * tt) AS DOUBLE), 6) AS sinusoid FROM met GROUP BY ALL""")
def k30(t: Tables) -> DataFrame:
    peaks = t.points.select("trial_id", (F.col("t_us") / UNIT).alias("peak"), (0.5 + F.col("unit_id") * 0.01).alias("sigma"))
    grid = t.trials.select("trial_id", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("i")).select("trial_id", (F.col("i") * 0.5).alias("t"))
    a, b = (fit.background(grid, peaks, k, 1.0, 2.0).withColumnRenamed("intensity", k) for k in ("gaussian", "laplacian"))
    return rounded(a.join(b, ["trial_id", "t"]).withColumn("sinusoid", fit.sinusoid(F.col("t"), 30.0, 5.0, 0.25)), "gaussian", "laplacian", "sinusoid")


#: Columns of each basis: the count of x in the bin, its mean in the jitter window, or both.
BASES = {"B1": ["x"], "B0": ["wx"], "B0B1": ["wx", "x"]}


def linear_fits(t: Tables, bases: list[str], jitter: str = "interval") -> DataFrame:
    """(src, dst, basis, beta, nll, converged): y's rate in a bin is linear in a constant and the basis."""
    total = BINS * t.n_trials

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, out = pdf["w"].to_numpy(float), []
        sums = {"x": float(pdf["n_x"].iloc[0]), "wx": float(pdf["n_w"].iloc[0])}
        for basis in bases:
            x = np.column_stack([np.ones(len(pdf)), pdf[BASES[basis]]])
            area = np.array([total] + [sums[c] for c in BASES[basis]])
            f = numeric.newton_best(x, w, area)
            beta = None if f["beta"] is None else f["beta"].tolist()
            out.append({"src": pdf["src"].iloc[0], "dst": pdf["dst"].iloc[0], "basis": basis, "beta": beta, "nll": f["nll"], "converged": f["converged"]})
        return pd.DataFrame(out)

    return design.jitter_rows(t.bins, t.pairs, BINS, WINDOW_BINS, jitter).groupBy("src", "dst").applyInPandas(run, "src long, dst long, basis string, beta array<double>, nll double, converged boolean")


def lrt(t: Tables) -> DataFrame:
    """(src, dst, nll0, nll1, stat, p): constant and jitter mean against the same with x itself; null where one has no best fit."""
    side = linear_fits(t, ["B0", "B0B1"]).groupBy("src", "dst").pivot("basis", ["B0", "B0B1"]).agg(F.first("nll")).toDF("src", "dst", "nll0", "nll1")
    ratio = 2 * (F.col("nll0") - F.col("nll1"))
    stat = F.when(ratio.isNotNull(), F.greatest(ratio, F.lit(0.0)))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else None)

    return side.withColumn("stat", stat).withColumn("p", tail("stat"))


@query("f7_binned_regression")
def f7(t: Tables) -> DataFrame:
    """Linear link on the bases B1, B0 and B0B1, per pair."""
    return linear_fits(t, list(BASES))


@query("f7_interval_binary")
def f7d(t: Tables) -> DataFrame:
    """The jitter basis is the chance that a bin of y's window has at least one event of x."""
    return linear_fits(t, ["B0", "B0B1"], "interval_binary")


@query("f7_basic_jitter")
def f7e(t: Tables) -> DataFrame:
    """The jitter basis is x's mean over a window around y."""
    return linear_fits(t, ["B0", "B0B1"], "basic")


@query("f7_exponential_link")
def f7c(t: Tables) -> DataFrame:
    """Exponential link on B1, per pair: bins count by the number of x events in them, with y's events there summed."""
    y = t.bins.groupBy(F.col("unit_id").alias("dst")).agg(F.sum("n").alias("n_y"))
    rows = design.jitter_rows(t.bins, t.pairs, BINS, WINDOW_BINS).groupBy("src", "dst", "x").agg(F.sum("w").alias("y"))
    bins_of = t.bins.groupBy(F.col("unit_id").alias("src"), F.col("n").cast("double").alias("x")).agg(F.count("*").alias("bins"))
    filled = bins_of.groupBy("src").agg((BINS * t.n_trials - F.sum("bins")).alias("bins")).select("src", F.lit(0.0).alias("x"), "bins").unionByName(bins_of)
    table = filled.join(t.pairs, "src").join(y, "dst").join(rows, ["src", "dst", "x"], "left").fillna(0, ["y"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), pdf["x"]])
        f = numeric.newton_exp(x, pdf["y"].to_numpy(float), pdf["bins"].to_numpy(float))
        return pd.DataFrame([{"src": pdf["src"].iloc[0], "dst": pdf["dst"].iloc[0], "beta": f["beta"].tolist(), "nll": f["nll"], "converged": f["converged"]}])

    return table.groupBy("src", "dst").applyInPandas(run, "src long, dst long, beta array<double>, nll double, converged boolean")


@query("f7_least_squares", """, nx AS (SELECT unit_id AS src, sum(n) AS sx, sum(n * n) AS sxx FROM bins GROUP BY ALL), ny AS (SELECT unit_id AS dst, sum(n) AS sy FROM bins GROUP BY ALL),
xy AS (SELECT p.src, p.dst, sum(x.n * y.n) AS sxy FROM pairs p JOIN bins x ON x.unit_id = p.src JOIN bins y ON y.unit_id = p.dst AND y.trial_id = x.trial_id AND y.bin = x.bin GROUP BY ALL)
SELECT p.src, p.dst, round((coalesce(sxy, 0) - sx * sy / (288.0 * (SELECT count(*) FROM trials))) / (sxx - sx * sx / (288.0 * (SELECT count(*) FROM trials))), 6) AS slope FROM pairs p JOIN nx USING (src) JOIN ny USING (dst) LEFT JOIN xy ON xy.src = p.src AND xy.dst = p.dst""")
def f7b(t: Tables) -> DataFrame:
    """Least squares of y on [1, x] over all bins, by the normal equations."""
    from tidewell.operators.synchrony import binned_synchrony

    x = t.bins.groupBy(F.col("unit_id").alias("src")).agg(F.sum("n").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("sxx"))
    y = t.bins.groupBy(F.col("unit_id").alias("dst")).agg(F.sum("n").alias("sy"))
    xy = binned_synchrony(t.bins, t.pairs).groupBy("src", "dst").agg(F.sum("n").alias("sxy"))
    n, c = BINS * t.n_trials, F.col
    slope = (F.coalesce("sxy", F.lit(0)) - c("sx") * c("sy") / n) / (c("sxx") - c("sx") * c("sx") / n)
    return rounded(t.pairs.join(x, "src").join(y, "dst").join(xy, ["src", "dst"], "left").select("src", "dst", slope.alias("slope")), "slope")


@query("f8_likelihood_ratio")
def f8(t: Tables) -> DataFrame:
    return lrt(t)


@query("f9_multivariate_regression")
def f9(t: Tables) -> DataFrame:
    """All sources of a target in one binned regression: each brings x and its jitter mean."""
    window = F.floor(F.col("bin") / WINDOW_BINS)
    x = t.bins.select(F.col("unit_id").alias("src"), "trial_id", F.col("bin").alias("y_us"), F.col("n").cast("double").alias("x"))
    xw = t.bins.groupBy(F.col("unit_id").alias("src"), "trial_id", window.alias("window")).agg((F.sum("n") / WINDOW_BINS).alias("wx"))
    y = t.bins.select(F.col("unit_id").alias("dst"), "trial_id", F.col("bin").alias("y_us"), window.alias("window"), F.col("n").alias("w")).join(t.pairs, "dst")
    mean = t.bins.groupBy(F.col("unit_id").alias("src")).agg((F.sum("n") / (BINS * t.n_trials)).alias("m"))
    d = y.join(x, ["src", "trial_id", "y_us"], "left").join(xw, ["src", "trial_id", "window"], "left").join(mean, "src").fillna(0.0, ["x", "wx"])
    d = d.withColumns({"x": F.col("x") - F.col("m"), "wx": F.col("wx") - F.col("m")})
    return multivariate.fit_multivariate(d.select("dst", "trial_id", "y_us", "w", "src", "wx", "x"), ["wx", "x"], [float(BINS * t.n_trials), 0.0, 0.0])


@query("f9_jitter_test")
def f9b(t: Tables) -> DataFrame:
    """Every source's coefficient beside all other sources of its target, against REPS joint surrogates of the sources."""
    return multivariate.jitter_test(t.points, t.pairs, WINDOW_BINS * BIN, REPS, BIN, BINS, t.n_trials)


#: Kernel widths of the network, half an hour to ten hours, in bins.
NETWORK_WIDTHS = [6.0, 9.0, 12.0, 18.0, 24.0, 30.0, 36.0, 42.0, 48.0, 60.0, 72.0, 84.0, 96.0, 120.0]


def network(t: Tables) -> DataFrame:
    """(src, dst, src_probe, dst_probe, width): ordered pairs of active units on different probes, with their probe pair's
    kernel width in microseconds; WIDTH where no pair of the two probes has events in one trial."""
    active = select.active_units(rates(t), 0.5).select("unit_id")
    units = t.units.join(active, "unit_id", "left_semi").select("unit_id", "probe")
    a, b = (units.select(F.col("unit_id").alias(c), F.col("probe").alias(f"{c}_probe")) for c in ("src", "dst"))
    probes = units.select(F.col("probe").alias("src_probe")).distinct()
    both = probes.join(probes.withColumnRenamed("src_probe", "dst_probe"), F.col("src_probe") != F.col("dst_probe"))  # a row a pair of probes
    wanted = a.join(both, "src_probe").join(b, "dst_probe").select("src", "dst", "src_probe", "dst_probe")
    chosen = fit.settle(design.pooled_width(t.bins, wanted, ["src_probe", "dst_probe"], NETWORK_WIDTHS, 12, BINS))
    width = F.coalesce((F.col("width") * BIN).cast("long"), F.lit(WIDTH))
    return wanted.join(chosen.select("src_probe", "dst_probe", "width"), ["src_probe", "dst_probe"], "left").withColumn("width", width)


@query("w1_network")
def w1(t: Tables) -> DataFrame:
    """Active units, ordered pairs between probes, a kernel width a probe pair, one design, a fit a pair, Wald tests,
    adjusted p, edges with attributes; ``width`` in hours."""
    wanted = fit.settle(network(t))
    fits = fit.standard_fits(t.points, wanted.select("src", "dst", "width"), t.n_trials, DAY, LENGTH, None, UNIT)
    found = fit.inference(fits, 2)
    tested = testing.adjust(found.withColumnRenamed("pval", "p")).withColumn("significant", F.coalesce(F.col("bh") < 0.05, F.lit(False)))
    width = wanted.select("src", "dst", (F.col("width") / HOUR).alias("width"))
    return pairs.with_attributes(tested, t.units).drop("by", "bonferroni").join(width, ["src", "dst"])


@query("w3_membership_rounds")
def w3(t: Tables) -> DataFrame:
    """Two rounds of pooled filters and updated memberships: (group_id, height, portion) at the end."""
    member = t.membership
    for _ in range(2):
        totals = member.where("group_id is not null").groupBy("group_id").agg(F.array(F.count("*") * HOURS, F.lit(0.0), F.lit(0.0)).alias("total"))
        pooled = fit.pooled_blocks(grouped_blocks(t, member), ["group_id"], len(COLUMNS), totals)
        shares = {r.group_id: r.portion for r in fit.portions(member).collect()}
        heights = {r.group_id: r.h for r in pooled.select("group_id", F.col("beta")[2].alias("h")).collect()}  # five groups
        best = fit.update_membership(t.pairs, member_nlls(t, heights, shares))
        member = fit.settle(t.membership.drop("group_id").join(best, ["src", "dst"]))
    return t.spark.createDataFrame([(g, h, shares[g]) for g, h in sorted(heights.items())], "group_id int, height double, portion double")
