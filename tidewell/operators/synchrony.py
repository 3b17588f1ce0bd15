"""Synchrony of pairs, and coupling strengths in closed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import numeric
from tidewell.operators.ccg import poisson_test
from tidewell.operators.timejoin import delays
from tidewell.operators.trains import against, met, surrogate_synchrony, totals


def synchrony(points: DataFrame, pairs: DataFrame, delta: int, low: int | None = None, high: int | None = None, x_points: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, trial_id, keys, n): how many (x, y) have abs(y - x) <= delta; x inside [low, high) if given.

    Trials of a pair without any are not in the result. Trains meet as arrays, and no two events as rows; only where
    ``x_points`` with its extra ``keys`` replaces the x side are its rows joined.
    """
    if x_points is None:
        inside = (None, None) if low is None else (low, high)
        return totals(points, pairs.select("src", "dst"), {"n": met(-delta - 1, delta, *inside)}).where("n > 0")
    x = x_points.select(F.col("unit_id").alias("src"), "trial_id", *keys, "t_us")
    if low is not None:
        x = x.where((F.col("t_us") >= low) & (F.col("t_us") < high))
    y = points.select(F.col("unit_id").alias("dst"), "trial_id", "t_us")
    near = delays(x.join(pairs, "src"), y, -delta - 1, delta, ("dst", "trial_id"))
    return near.groupBy("src", "dst", "trial_id", *keys).agg(F.count("*").alias("n"))


def binned_synchrony(bins: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, trial_id, n): sum of the products of both counts over the bins."""
    x = bins.select(F.col("unit_id").alias("src"), "trial_id", "bin", F.col("n").alias("nx"))
    y = bins.select(F.col("unit_id").alias("dst"), "trial_id", "bin", F.col("n").alias("ny"))
    return x.join(pairs, "src").join(y, ["dst", "trial_id", "bin"]).groupBy("src", "dst", "trial_id").agg(F.sum(F.col("nx") * F.col("ny")).alias("n"))


def jitter_p(points: DataFrame, pairs: DataFrame, delta: int, width: int, reps: int, basic: bool = False, seed: int = 0) -> DataFrame:
    """(src, dst, s, p, p_rnd): (surrogates with at least as much synchrony + 1) / (reps + 1).

    p_rnd: the same after a draw from [0, 0.5) is added to every count, as counts tie.
    """
    def judge(r, n: np.ndarray) -> list[tuple]:
        s, n = int(n[0, 0]), n[1:, 0]
        mine = numeric.uniform_of(r.src, r.dst, seed)  # decides between equals
        ties = sum(numeric.uniform_of(r.src, r.dst, i + 1, seed) >= mine for i in np.flatnonzero(n == s).tolist())
        return [(r.src, r.dst, s, ((n >= s).sum() + 1) / (reps + 1), ((n > s).sum() + ties + 1) / (reps + 1))]

    counts = surrogate_synchrony(points, pairs, width, reps, delta, basic, seed, own=True)  # x itself is counted beside its surrogates
    return against(counts, pairs.select("src", "dst", F.array(F.lit(0)).alias("own")), reps + 1, judge, "src long, dst long, s long, p double, p_rnd double")


def closed_beta(bins: DataFrame, pairs: DataFrame, delta: int) -> DataFrame:
    """(src, dst, s, n_x, b1_cnt, b1_binary, b0, log_b1): synchrony over x events, in four versions.

    b1_cnt: counts; b1_binary: x as 0 or 1; b0: whether x has an event in y's jitter window of ``delta`` bins;
    log_b1: ln of b1_cnt, for the exponential link, null without synchrony.
    """
    n_x = bins.groupBy(F.col("unit_id").alias("src")).agg(F.sum("n").alias("n_x"), F.count("*").alias("bins_x"))
    x = bins.select(F.col("unit_id").alias("src"), "trial_id", "bin", F.col("n").alias("nx")).join(pairs, "src")
    y = bins.select(F.col("unit_id").alias("dst"), "trial_id", "bin", F.col("n").alias("ny"))
    same = x.join(y, ["dst", "trial_id", "bin"]).groupBy("src", "dst").agg(F.sum(F.col("nx") * F.col("ny")).alias("s"), F.sum("ny").alias("s_binary"))
    window = F.floor(F.col("bin") / delta).alias("window")
    hit = bins.select(F.col("unit_id").alias("src"), "trial_id", window).distinct().join(pairs, "src")
    near = hit.join(y.withColumn("window", window), ["dst", "trial_id", "window"]).groupBy("src", "dst").agg(F.sum("ny").alias("s0"))
    all_ = pairs.join(n_x, "src").join(same, ["src", "dst"], "left").join(near, ["src", "dst"], "left").fillna(0, ["s", "s_binary", "s0"])
    b1 = F.col("s") / F.col("n_x")
    return all_.select("src", "dst", "s", "n_x", b1.alias("b1_cnt"), (F.col("s_binary") / F.col("bins_x")).alias("b1_binary"), (F.col("s0") / F.col("n_x")).alias("b0"), F.when(F.col("s") > 0, F.ln(F.when(F.col("s") > 0, b1))).alias("log_b1"))


def closed_beta_mean(bins: DataFrame, pairs: DataFrame, delta: int) -> DataFrame:
    """(src, dst, mean_binary, mean_cnt): what the strengths would be if x events moved freely in their windows."""
    n_x = bins.groupBy(F.col("unit_id").alias("src")).agg(F.sum("n").alias("n_x"))
    window = F.floor(F.col("bin") / delta).alias("window")
    x = bins.groupBy(F.col("unit_id").alias("src"), "trial_id", window).agg(F.sum("n").alias("c")).join(pairs, "src")
    y = bins.groupBy(F.col("unit_id").alias("dst"), "trial_id", window).agg(F.sum("n").alias("ny"))
    sums = x.join(y, ["dst", "trial_id", "window"]).groupBy("src", "dst").agg(
        F.sum(F.col("ny") * (1 - F.pow(F.lit(1 - 1 / delta), F.col("c")))).alias("sb"), F.sum(F.col("ny") * F.col("c")).alias("sc")
    )
    all_ = pairs.join(n_x, "src").join(sums, ["src", "dst"], "left").fillna(0, ["sb", "sc"])
    return all_.select("src", "dst", (F.col("sb") / F.col("n_x")).alias("mean_binary"), (F.col("sc") / (F.col("n_x") * delta)).alias("mean_cnt"))


def beta_mc_test(bins: DataFrame, surrogate: DataFrame, pairs: DataFrame, reps: int, alpha: float = 0.05, correct: str | None = None, delta: int = 1) -> DataFrame:
    """(src, dst, beta, mean, ci_lo, ci_hi, p): b1_cnt against surrogates of x (trains.surrogate_ccg at lag 0).

    ``correct``: the null mean (``cnt`` or ``binary``, in windows of ``delta`` bins) to take off beta, mean and interval,
    which leaves p as it is.
    """
    n_x = bins.groupBy(F.col("unit_id").alias("src")).agg(F.sum("n").alias("n_x"))
    raw = binned_synchrony(bins, pairs).groupBy("src", "dst").agg(F.sum("n").alias("s"))
    own = pairs.join(n_x, "src").join(raw, ["src", "dst"], "left").select("src", "dst", "n_x", F.array(F.coalesce("s", F.lit(0))).alias("own"))

    def judge(r, n: np.ndarray) -> list[tuple]:
        beta, j = r.own[0] / r.n_x, n[:, 0] / r.n_x
        return [(r.src, r.dst, beta, j.mean(), *np.quantile(j, [alpha / 2, 1 - alpha / 2]), ((n[:, 0] >= r.own[0]).sum() + 1) / (reps + 1))]

    tested = against(surrogate, own, reps, judge, "src long, dst long, beta double, mean double, ci_lo double, ci_hi double, p double")
    if correct is None:
        return tested
    off = closed_beta_mean(bins, pairs, delta).select("src", "dst", F.col(f"mean_{correct}").alias("off"))
    return tested.join(off, ["src", "dst"]).select("src", "dst", *[(F.col(c) - F.col("off")).alias(c) for c in ("beta", "mean", "ci_lo", "ci_hi")], "p")


def beta_poisson_test(bins: DataFrame, pairs: DataFrame, delta: int, correct: str | None = None, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(src, dst, beta, mean, ci_lo, ci_hi, p, p_rnd): b1_cnt against a Poisson number of coincidences.

    Its mean is that of x events moving freely in their windows. ``correct``: the null mean (``cnt`` or ``binary``) to take
    off beta, mean and interval, which leaves p as it is.
    """
    mu = closed_beta_mean(bins, pairs, delta)
    off = F.col(f"mean_{correct}") if correct else F.lit(0.0)
    both = closed_beta(bins, pairs, delta).join(mu, ["src", "dst"]).select(
        "src", "dst", F.lit(0).alias("lag"), F.col("s").alias("raw"), (F.col("mean_cnt") * F.col("n_x")).alias("mu"), "n_x", off.alias("off")
    )
    tested = poisson_test(both.select("src", "dst", "lag", "raw"), both.select("src", "dst", "lag", "mu"), alpha, seed)
    scaled = lambda c: F.col(c) / F.col("n_x") - F.col("off")
    return tested.join(both.select("src", "dst", "n_x", "off"), ["src", "dst"]).select(
        "src", "dst", scaled("raw").alias("beta"), scaled("mu").alias("mean"), scaled("ci_lo").alias("ci_lo"), scaled("ci_hi").alias("ci_hi"), "p", "p_rnd"
    )


def beta_exact_test(bins: DataFrame, pairs: DataFrame, delta: int, correct: bool = False, alpha: float = 0.05) -> DataFrame:
    """(src, dst, s, beta, mean, ci_lo, ci_hi, p): bins in which both have an event, over x's bins with one, against the exact
    law of x's events thrown anew into windows of ``delta`` bins.

    A window of n events of x and m bins with events of y hits some of the m bins, by the occupancy law; windows alike are
    one power of it. The count's law is that of their sum. ``correct``: the null mean is taken off beta, mean and interval,
    which leaves p as it is.
    """
    window = F.floor(F.col("bin") / delta).alias("window")
    x = bins.groupBy(F.col("unit_id").alias("src"), "trial_id", window).agg(F.sum("n").alias("n"))
    y = bins.groupBy(F.col("unit_id").alias("dst"), "trial_id", window).agg(F.count("*").alias("m"))
    kinds = x.join(pairs, "src").join(y, ["dst", "trial_id", "window"]).groupBy("src", "dst", "m", "n").agg(F.count("*").cast("int").alias("times"))
    packed = kinds.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("m", "n", "times"))).alias("windows"))
    hit = bins.select(F.col("unit_id").alias("src"), "trial_id", "bin").join(pairs, "src").join(bins.select(F.col("unit_id").alias("dst"), "trial_id", "bin"), ["dst", "trial_id", "bin"])
    n_x = bins.groupBy(F.col("unit_id").alias("src")).agg(F.count("*").alias("bins_x"))
    both = packed.join(hit.groupBy("src", "dst").agg(F.count("*").alias("s")), ["src", "dst"], "left").fillna(0, ["s"]).join(n_x, "src")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pmf = np.ones(1)
                for w in r.windows:
                    pmf = np.convolve(pmf, numeric.power_pmf(np.array(numeric.occupancy_pmf(int(w["m"]), delta, int(w["n"]))), int(w["times"])))
                low, high, mean, p, _ = numeric.pmf_summary(pmf, r.s, alpha, 0.5)
                out.append((r.src, r.dst, r.s, *[(v - mean * correct) / r.bins_x for v in (r.s, mean, low, high)], p))
            yield pd.DataFrame(out, columns=["src", "dst", "s", "beta", "mean", "ci_lo", "ci_hi", "p"])

    return both.mapInPandas(run, "src long, dst long, s long, beta double, mean double, ci_lo double, ci_hi double, p double")


def train_nll(bins: DataFrame, log_rate: DataFrame) -> DataFrame:
    """(unit_id, trial_id, nll): -sum n log(rate) + sum rate over bins. log_rate: unit_id, trial_id, bin, log_rate, dense."""
    both = log_rate.join(bins, ["unit_id", "trial_id", "bin"], "left")
    return both.groupBy("unit_id", "trial_id").agg(F.sum(F.exp("log_rate") - F.coalesce("n", F.lit(0)) * F.col("log_rate")).alias("nll"))
