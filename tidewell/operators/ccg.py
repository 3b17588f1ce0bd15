"""Cross-correlograms of pairs, their jitter nulls and tests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import numeric
from tidewell.functions.columns import corr, norm_cdf, uniform
from tidewell.operators import binning, trains
from tidewell.operators.timejoin import delays
from tidewell.sources.shared import settle


def ccg(bins: DataFrame, pairs: DataFrame, low: int, high: int, bins_x: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, keys, lag, raw): sum over trials and bins of x[b] y[b + lag], every lag from low to high.

    Only bins with events are joined. ``bins_x`` (unit_id, trial_id, keys, bin, n) replaces the x side, as surrogates
    do. Lags that nothing meets are 0 for every pair (and every key that occurs).
    """
    x = (bins if bins_x is None else bins_x).select(F.col("unit_id").alias("src"), "trial_id", *keys, F.col("bin").alias("t_us"), F.col("n").alias("nx"))
    y = bins.select(F.col("unit_id").alias("dst"), "trial_id", F.col("bin").alias("t_us"), F.col("n").alias("ny"))
    met = delays(x.join(pairs, "src"), y, low - 1, high, ("dst", "trial_id"))
    products = met.groupBy("src", "dst", *keys, F.col("d").cast("int").alias("lag")).agg(F.sum(F.col("nx") * F.col("ny")).alias("raw"))
    frame = pairs if not keys else pairs.join(x.select(*keys).distinct())  # every pair with every key: rows of the result
    full = frame.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return full.join(products, ["src", "dst", *keys, "lag"], "left").withColumn("raw", F.coalesce("raw", F.lit(0)))


def window_product(bins: DataFrame, pairs: DataFrame, low: int, high: int, delta: int) -> DataFrame:
    """(src, dst, lag, trial_id, window, m, n): y events, moved back by the lag, and x events in each jitter window."""
    lags = F.explode(F.sequence(F.lit(low), F.lit(high)))
    y = bins.withColumn("lag", lags).groupBy(
        F.col("unit_id").alias("dst"), "trial_id", "lag", F.floor((F.col("bin") - F.col("lag")) / delta).alias("window")
    ).agg(F.sum("n").alias("m"))
    x = bins.groupBy(F.col("unit_id").alias("src"), "trial_id", F.floor(F.col("bin") / delta).alias("window")).agg(F.sum("n").alias("n"))
    return x.join(pairs, "src").join(y, ["dst", "trial_id", "window"]).select("src", "dst", "lag", "trial_id", "window", "m", "n")


def poisson_mean(bins: DataFrame, pairs: DataFrame, low: int, high: int, delta: int) -> DataFrame:
    """(src, dst, lag, mu): the expected correlogram when x events move freely in their windows of ``delta`` bins."""
    mu = window_product(bins, pairs, low, high, delta).groupBy("src", "dst", "lag").agg((F.sum(F.col("m") * F.col("n")) / delta).alias("mu"))
    full = pairs.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return full.join(mu, ["src", "dst", "lag"], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))


def normal_moments(bins: DataFrame, pairs: DataFrame, low: int, high: int, delta: int) -> DataFrame:
    """(src, dst, lag, mean, var) with p = m / delta per window: sums of p n and p (1 - p) n."""
    p = F.col("m") / delta
    made = window_product(bins, pairs, low, high, delta).groupBy("src", "dst", "lag").agg(F.sum(p * F.col("n")).alias("mean"), F.sum(p * (1 - p) * F.col("n")).alias("var"))
    full = pairs.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return full.join(made, ["src", "dst", "lag"], "left").fillna(0.0, ["mean", "var"])


def normal_test(raw: DataFrame, moments: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(src, dst, lag, raw, mean, ci_lo, ci_hi, p)."""
    sd = F.sqrt("var")
    tail = F.when(F.col("var") > 0, 1 - norm_cdf((F.col("raw") - F.col("mean")) / F.when(F.col("var") > 0, sd))).otherwise(F.when(F.col("raw") > F.col("mean"), 0.0).otherwise(1.0))
    return raw.join(moments, ["src", "dst", "lag"]).select(
        "src", "dst", "lag", "raw", "mean", (F.col("mean") - z * sd).alias("ci_lo"), (F.col("mean") + z * sd).alias("ci_hi"), tail.alias("p")
    )


def poisson_test(raw: DataFrame, mean: DataFrame, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(src, dst, lag, raw, mu, ci_lo, ci_hi, p, p_rnd) from the Poisson tail at mu."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, mu, u in zip(pdf["raw"], pdf["mu"], pdf["u"], strict=True):
                low, masses = numeric.poisson_masses(mu)
                cdf = np.cumsum(masses)
                lower, upper = (low + int(min(np.searchsorted(cdf, q), len(cdf) - 1)) for q in (alpha / 2, 1 - alpha / 2))
                above = numeric.above(low, masses, n)
                at = numeric.above(low, masses, n - 1) - above
                rows.append((lower, upper, above + at, above + u * at))
            yield pdf.drop(columns="u").assign(**dict(zip(("ci_lo", "ci_hi", "p", "p_rnd"), np.array(rows, float).reshape(-1, 4).T, strict=True)))

    both = raw.join(mean, ["src", "dst", "lag"]).select("src", "dst", "lag", "raw", "mu", uniform("src", "dst", "lag", seed).alias("u"))
    return both.mapInPandas(run, "src long, dst long, lag int, raw long, mu double, ci_lo double, ci_hi double, p double, p_rnd double")


def mass_test(raw: DataFrame, windows: DataFrame, delta: int, law: str = "binom", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(src, dst, lag, raw, ci_lo, ci_hi, mean, p, p_rnd) by the mass function of the null.

    ``binom``: the exact one, a sum of Binom(n, m / delta) over windows; ``poisson`` and ``normal``: that of their mean (and
    variance), cut where it is below 1e-12. Equal (m, n) are counted first and convolved by powers.
    """
    kinds = windows.groupBy("src", "dst", "lag", "m", "n").agg(F.count("*").cast("int").alias("times"))
    packed = kinds.groupBy("src", "dst", "lag").agg(F.array_sort(F.collect_list(F.struct("m", "n", "times"))).alias("windows"))

    def mass(ws: list) -> tuple[int, np.ndarray]:
        if law == "binom":
            return numeric.joint_binom_masses([(w["m"], w["n"], w["times"]) for w in ws], delta)
        most = sum((w["m"] + w["n"]) * w["times"] for w in ws)
        mean = sum(w["m"] * w["n"] * w["times"] for w in ws) / delta
        if law == "poisson":
            return numeric.poisson_law(mean, most)
        return numeric.normal_law(mean, sum(w["m"] / delta * (1 - w["m"] / delta) * w["n"] * w["times"] for w in ws), most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            laws = (mass(ws if ws is not None else []) for ws in pdf["windows"])
            rows = [numeric.pmf_summary(p, n, alpha, u, start) for n, u, (start, p) in zip(pdf["raw"], pdf["u"], laws, strict=True)]
            yield pdf.drop(columns=["u", "windows"]).assign(**dict(zip(("ci_lo", "ci_hi", "mean", "p", "p_rnd"), np.array(rows, float).reshape(-1, 5).T, strict=True)))

    both = raw.join(packed, ["src", "dst", "lag"], "left").select("src", "dst", "lag", "raw", uniform("src", "dst", "lag", seed).alias("u"), "windows")
    return both.mapInPandas(run, "src long, dst long, lag int, raw long, ci_lo double, ci_hi double, mean double, p double, p_rnd double")


#: The tests of pair_tests.
KINDS = ("mc", "mc_sim", "binom", "poisson", "poisson_pmf", "normal_pmf", "normal")


def pair_tests(points: DataFrame, pairs: DataFrame, kinds: tuple[str, ...], bin_width: int, n_bins: int, low: int, high: int, delta: int, reps: int, alpha: float = 0.05) -> DataFrame:
    """(src, dst, lag, raw, kind, mean, ci_lo, ci_hi, p): correlograms of all pairs against interval jitter in windows of
    ``delta`` bins, by the tests named in ``kinds``.

    Correlograms, surrogates and window counts are made once for all the tests that use them. ``mc_sim`` has one band over
    all lags, and p is that of the pair's highest lag.
    """
    if set(kinds) - set(KINDS):
        raise ValueError(f"no such test: {sorted(set(kinds) - set(KINDS))}")
    bins = binning.bins(points, bin_width)
    raw, key = ccg(bins, pairs, low, high), ["src", "dst", "lag"]
    surrogate = trains.surrogate_ccg(points, pairs, delta * bin_width, reps, bin_width, n_bins, low, high) if {"mc", "mc_sim"} & set(kinds) else None
    if surrogate is not None and {"mc", "mc_sim"} <= set(kinds):
        surrogate = settle(surrogate)
    windows = lambda: window_product(bins, pairs, low, high, delta)
    made = {
        "mc": lambda: mc_test(raw, surrogate, reps, alpha),
        "mc_sim": lambda: simultaneous_band(raw, surrogate, reps, alpha).withColumnRenamed("p_up", "p"),
        "binom": lambda: mass_test(raw, windows(), delta, "binom", alpha),
        "poisson": lambda: poisson_test(raw, poisson_mean(bins, pairs, low, high, delta), alpha).withColumnRenamed("mu", "mean"),
        "poisson_pmf": lambda: mass_test(raw, windows(), delta, "poisson", alpha),
        "normal_pmf": lambda: mass_test(raw, windows(), delta, "normal", alpha),
        "normal": lambda: normal_test(raw, normal_moments(bins, pairs, low, high, delta), numeric.norm_ppf(1 - alpha / 2)),
    }
    return reduce(DataFrame.unionAll, [made[k]().select(*key, "raw", F.lit(k).alias("kind"), "mean", "ci_lo", "ci_hi", "p") for k in kinds])


def interval_jitter(points: DataFrame, width: int, reps: int, seed: int = 0) -> DataFrame:
    """(unit_id, trial_id, rep, t_us): every event anew, anywhere in its window [k width, (k + 1) width).

    Draws are hashes of the event, so a surrogate is the same wherever it is made. Made once a unit and shared by
    all its pairs.
    """
    u = uniform("unit_id", "trial_id", "t_us", "rep", seed)
    start = F.floor(F.col("t_us") / width) * width
    return points.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("unit_id", "trial_id", "rep", (start + F.floor(u * width)).alias("t_us"))


def basic_jitter(points: DataFrame, width: int, reps: int, seed: int = 0) -> DataFrame:
    """Every event anew around its old place: t - width / 2 + u width."""
    u = uniform("unit_id", "trial_id", "t_us", "rep", seed)
    moved = F.col("t_us") - width // 2 + F.floor(u * width)
    return points.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("unit_id", "trial_id", "rep", moved.alias("t_us"))


def lag_arrays(raw: DataFrame) -> DataFrame:
    """(src, dst, lags, own): a pair's correlogram as arrays, in order of the lags."""
    one = raw.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("lag", "raw"))).alias("e"))
    return one.select("src", "dst", F.col("e.lag").alias("lags"), F.col("e.raw").alias("own"))


def mc_test(raw: DataFrame, surrogate: DataFrame, reps: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(src, dst, lag, raw, mean, ci_lo, ci_hi, p, p_rnd) from trains.surrogate_ccg.

    p = (surrogates above + 1) / (reps + 1); for p_rnd both sides get a hash uniform in [0, 1), which decides between equals.
    """
    def judge(r, n: np.ndarray) -> list[tuple]:
        own = np.asarray(r.own)
        lo, hi = np.quantile(n, [alpha / 2, 1 - alpha / 2], axis=0)
        above, out = (n > own).sum(axis=0), []
        for k, lag in enumerate(r.lags):
            mine = numeric.uniform_of(r.src, r.dst, lag, seed)
            ties = sum(numeric.uniform_of(r.src, r.dst, lag, i + 1, seed) > mine for i in np.flatnonzero(n[:, k] == own[k]).tolist())
            out.append((r.src, r.dst, lag, own[k], n[:, k].mean(), lo[k], hi[k], (above[k] + 1) / (reps + 1), (above[k] + ties + 1) / (reps + 1)))
        return out

    return trains.against(surrogate, lag_arrays(raw), reps, judge, "src long, dst long, lag int, raw long, mean double, ci_lo double, ci_hi double, p double, p_rnd double")


def simultaneous_band(raw: DataFrame, surrogate: DataFrame, reps: int, alpha: float = 0.05) -> DataFrame:
    """(src, dst, lag, raw, mean, ci_lo, ci_hi, p_up, p_down): one band over all lags of a pair.

    Surrogates are standardised per lag, their largest and smallest value over the lags taken, and the quantiles of
    these put back on each lag's scale. Lags whose surrogates don't vary take no part.
    """
    def judge(r, n: np.ndarray) -> list[tuple]:
        # whole numbers until the last step, and values rounded before they are compared: equal ones stay equal
        s, q = n.sum(axis=0), (n * n).sum(axis=0)
        some = np.flatnonzero(reps * q > s * s)
        if not len(some):
            return []
        s, own, n = s[some], np.asarray(r.own)[some], n[:, some]
        root = np.sqrt((reps * q[some] - s * s).astype(float))
        z = lambda v: np.round((v * reps - s) / root, 9)
        top, low, mine = z(n).max(axis=1), z(n).min(axis=1), z(own)
        q_low, q_top = np.quantile(low, alpha / 2), np.quantile(top, 1 - alpha / 2)
        p_up, p_down = (mine.max() < top).mean(), (mine.min() > low).mean()
        mean, sd = s / reps, root / reps
        return [(r.src, r.dst, r.lags[k], own[i], mean[i], q_low * sd[i] + mean[i], q_top * sd[i] + mean[i], p_up, p_down) for i, k in enumerate(some)]

    return trains.against(surrogate, lag_arrays(raw), reps, judge, "src long, dst long, lag int, raw long, mean double, ci_lo double, ci_hi double, p_up double, p_down double")


def height_rank(raw: DataFrame, surrogate: DataFrame, reps: int) -> DataFrame:
    """(src, dst, h, p): a pair's coincidences at positive lags, and their two-sided rank among the surrogates'."""
    def judge(r, n: np.ndarray) -> list[tuple]:
        late = np.asarray(r.lags) > 0
        h = float(np.asarray(r.own)[late].sum())
        q = float((h > n[:, late].sum(axis=1)).mean())
        return [(r.src, r.dst, h, 2 * min(q, 1 - q))]

    return trains.against(surrogate, lag_arrays(raw), reps, judge, "src long, dst long, h double, p double")


def smoothed_mean(bins: DataFrame, pairs: DataFrame, low: int, high: int, half: int, n_bins: int) -> DataFrame:
    """(src, dst, lag, mu): the correlogram with x replaced by its moving average over 2 half + 1 bins."""
    around = bins.withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("bin", F.col("bin") + F.col("k")).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    mean = around.groupBy("unit_id", "trial_id", "bin").agg(F.sum("n").alias("n"))
    return ccg(bins, pairs, low, high, mean).withColumn("mu", F.col("raw") / (2 * half + 1)).drop("raw")


def significance(tests: DataFrame, threshold: float, lag_step: float = 1.0) -> DataFrame:
    """(src, dst, area_up, area_down, up, down): area of the correlogram beyond its band, per pair."""
    up, down = (F.sum(F.greatest(c, F.lit(0.0))) * lag_step for c in (F.col("raw") - F.col("ci_hi"), F.col("ci_lo") - F.col("raw")))
    return tests.groupBy("src", "dst").agg(up.alias("area_up"), down.alias("area_down")).withColumns({"up": F.col("area_up") > threshold, "down": F.col("area_down") > threshold})


def unit_correlograms(tests: DataFrame, significant: DataFrame, unit_id: int) -> DataFrame:
    """(other, lag, raw): the significant correlograms of a unit, lags as seen from it."""
    mine = tests.join(significant.select("src", "dst"), ["src", "dst"], "left_semi").where((F.col("src") == unit_id) | (F.col("dst") == unit_id))
    out = F.col("src") == unit_id
    return mine.select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"), F.when(out, F.col("lag")).otherwise(-F.col("lag")).alias("lag"), "raw")


def lag_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...], low: int, high: int) -> DataFrame:
    """(keys, lag, y1, y2): y1 at bin + lag with y2 at bin, for lags low to high. a, b: keys, bin, y1 or y2."""
    x = b.select(*keys, F.col("bin").alias("t_us"), "y2")
    y = a.select(*keys, F.col("bin").alias("t_us"), "y1")
    return delays(x, y, low - 1, high, keys).withColumn("lag", F.col("d").cast("int"))


def cross_corr(a: DataFrame, b: DataFrame, keys: tuple[str, ...], n_bins: int, low: int, high: int, debias: bool = True, normalise: bool = True) -> DataFrame:
    """(keys, lag, corr): sum of y1[b + lag] y2[b] over n - abs(lag) (or n), over the root of both mean squares.

    Series without energy are not divided by it. Bins without a row are 0.
    """
    met = lag_join(a, b, keys, low, high).groupBy(*keys, "lag").agg(F.sum(F.col("y1") * F.col("y2")).alias("s"))
    frame = a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi") if keys else a.sparkSession.range(1).select()
    full = frame.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(met, [*keys, "lag"], "left")
    size = (n_bins - F.abs("lag")) if debias else F.lit(n_bins)
    value = F.coalesce("s", F.lit(0.0)) / size
    if not normalise:
        return full.select(*keys, "lag", value.alias("corr"))
    e1 = a.groupBy(*keys).agg((F.sum(F.col("y1") * F.col("y1")) / n_bins).alias("e1"))
    e2 = b.groupBy(*keys).agg((F.sum(F.col("y2") * F.col("y2")) / n_bins).alias("e2"))
    both = full.join(e1, list(keys)).join(e2, list(keys))
    energy = F.col("e1") * F.col("e2")
    return both.select(*keys, "lag", F.when(energy > 0, value / F.sqrt(F.when(energy > 0, energy))).otherwise(value).alias("corr"))


def peak(corr: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, lag, corr) of the highest value; ties to the smallest lag."""
    best = F.max_by(F.struct("lag", "corr"), F.struct("corr", -F.col("lag"))).alias("best")
    return corr.groupBy(*keys).agg(best).select(*keys, "best.lag", "best.corr")


def pearson_lags(a: DataFrame, b: DataFrame, keys: tuple[str, ...], low: int, high: int) -> DataFrame:
    """(keys, lag, r): Pearson's r of y1[b + lag] and y2[b]; the series must be dense."""
    return lag_join(a, b, keys, low, high).groupBy(*keys, "lag").agg(corr("y1", "y2").alias("r"))


def centred_xcorr(a: DataFrame, b: DataFrame, keys: tuple[str, ...], n_bins: int, low: int, high: int) -> DataFrame:
    """(keys, lag, xcorr, level): centred, over the full energies, with the white-noise level 1.96 / sqrt n."""
    w = Window.partitionBy(*keys)
    ca, cb = a.withColumn("y1", F.col("y1") - F.avg("y1").over(w)), b.withColumn("y2", F.col("y2") - F.avg("y2").over(w))
    s = lag_join(ca, cb, keys, low, high).groupBy(*keys, "lag").agg(F.sum(F.col("y1") * F.col("y2")).alias("s"))
    e1, e2 = ca.groupBy(*keys).agg(F.sum(F.col("y1") ** 2).alias("e1")), cb.groupBy(*keys).agg(F.sum(F.col("y2") ** 2).alias("e2"))
    return s.join(e1, list(keys)).join(e2, list(keys)).where("e1 * e2 > 0").select(*keys, "lag", (F.col("s") / F.sqrt(F.col("e1") * F.col("e2"))).alias("xcorr"), F.lit(1.959963984540054 / n_bins**0.5).alias("level"))


def covariance_density(bins: DataFrame, n_bins: int, n_trials: int, dt: float, high: int) -> DataFrame:
    """(unit_id, lag, density): mean product of a train with itself lag bins later, over dt squared, less the rate squared."""
    x = bins.select("unit_id", "trial_id", F.col("bin").alias("t_us"), F.col("n").alias("nx"))
    y = bins.select("unit_id", "trial_id", F.col("bin").alias("t_us"), F.col("n").alias("ny"))
    s = delays(x, y, -1, high, ("unit_id", "trial_id")).groupBy("unit_id", F.col("d").cast("int").alias("lag")).agg(F.sum(F.col("nx") * F.col("ny")).alias("s"))
    rate = bins.groupBy("unit_id").agg((F.sum("n") / (n_bins * n_trials * dt)).alias("rate"))
    full = rate.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(high)))).join(s, ["unit_id", "lag"], "left")
    mean = F.coalesce("s", F.lit(0)) / ((n_bins - F.col("lag")) * n_trials) / (dt * dt)
    return full.select("unit_id", "lag", (mean - F.col("rate") * F.col("rate")).alias("density"))


def fisher(r: Column) -> Column:
    return 0.5 * F.ln((1 + r) / (1 - r))
