"""Design matrices of linear-intensity point-process regressions, in continuous and in binned time.

Continuous: one row for each y event of a pair, (src, dst, trial_id, y_us, w) with w events at that instant, and a
column for each regressor; besides, each regressor's integral over all trials. Regressors are summed train against train
in one pass (trains.regressors), not over joined pairs of events. Times of regressors are in units of ``unit``
microseconds, so that coefficients are of moderate size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import kernels
from tidewell.functions.columns import norm_cdf, uniform
from tidewell.operators.timejoin import delays
from tidewell.operators.trains import HELD, PARTNERS, Kernel, gaussian, gaussian_by_width, own_square, paired, regressors, square_filter, trains

KEYS = ["src", "dst", "trial_id", "y_us"]


def y_rows(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The frame: every y event of every pair, also those without an x event in reach."""
    return trains(points).withColumnRenamed("unit_id", "dst").join(pairs, "dst").select("src", "dst", "trial_id", F.col("t_us").alias("y_us"), F.col("c").alias("w"))


def around(points: DataFrame, pairs: DataFrame, low: int, high: int, value: Column, name: str, extra: list[Column] | None = None) -> DataFrame:
    """(src, dst, trial_id, y_us, name): sum of ``value``, a function of d (microseconds), over x events with low < d <= high."""
    t = trains(points)
    x = t.select(F.col("unit_id").alias("src"), "trial_id", "t_us", F.col("c").alias("cx")).join(pairs, "src")
    y = t.select(F.col("unit_id").alias("dst"), "trial_id", "t_us")
    return delays(x, y, low, high, ("dst", "trial_id")).groupBy(*KEYS, *(extra or [])).agg(F.sum(value * F.col("cx")).alias(name))


def per_source(points: DataFrame, value: Column, name: str = "integral") -> DataFrame:
    """(src, name): a sum over all events of a unit, such as an integral less its losses at the edges."""
    return points.groupBy(F.col("unit_id").alias("src")).agg(F.sum(value).alias(name))


def square(points: DataFrame, pairs: DataFrame, length: int, trial: int, unit: float) -> tuple[DataFrame, DataFrame]:
    """x events in [y - length, y), and its integral: each x event's length, cut at the trial's end."""
    return regressors(points, pairs, {"square": square_filter(length)}), square_integral(points, length, trial, unit)


def square_integral(points: DataFrame, length: int, trial: int, unit: float) -> DataFrame:
    t = F.col("t_us")
    lost = F.when(t > trial - length, length - (trial - t)).otherwise(0)
    return per_source(points, (length - lost) / unit)


def exponential(points: DataFrame, pairs: DataFrame, rate: float, trial: int, unit: float) -> tuple[DataFrame, DataFrame]:
    """Sum of exp(-rate d) over all earlier x events of the trial, with d in units; integral (1 - exp(-rate rest)) / rate."""
    rest = (trial - F.col("t_us")) / unit
    rows = regressors(points, pairs, {"exponential": partial(kernels.exponential, rate=rate, unit=unit)})
    return rows, per_source(points, (1 - F.exp(-rate * rest)) / rate)


def exponential_slope(points: DataFrame, pairs: DataFrame, rate: float, trial: int, unit: float) -> DataFrame:
    """The derivative of the exponential regressor by its rate: sum of -d exp(-rate d)."""
    return regressors(points, pairs, {"slope": partial(kernels.exponential_slope, rate=rate, unit=unit)})


def jitter_mean(points: DataFrame, pairs: DataFrame, width: int, unit: float) -> DataFrame:
    """x events in y's window of ``width``, per unit of time."""
    return regressors(points, pairs, {"jitter_mean": partial(kernels.window_count, width=width, scale=unit / width)})


def square_kernel(points: DataFrame, pairs: DataFrame, width: int, trial: int, unit: float) -> tuple[DataFrame, DataFrame]:
    """x events within half a width on both sides, per unit of time; its integral loses what lies outside the trial."""
    half, t = width // 2, F.col("t_us")
    lost = F.greatest(F.lit(0), half - t) + F.greatest(F.lit(0), half - (trial - t))
    return regressors(points, pairs, {"nuisance": partial(kernels.count, low=-half, high=half, scale=unit / width)}), per_source(points, 1 - lost / width)


def triangle_kernel(points: DataFrame, pairs: DataFrame, width: int, trial: int, unit: float) -> tuple[DataFrame, DataFrame]:
    half, t = width // 2, F.col("t_us")
    lost = lambda gap: F.when(gap < half, ((half - gap) / half) ** 2 / 2).otherwise(0.0)
    rows = regressors(points, pairs, {"nuisance": partial(kernels.triangle, half=half, scale=unit / half / half)})
    return rows, per_source(points, 1 - lost(t) - lost(trial - t))


def laplacian_kernel(points: DataFrame, pairs: DataFrame, width: int, unit: float) -> tuple[DataFrame, DataFrame]:
    """Within 3 widths, scale width / sqrt 2, per unit of time; the integral is not corrected at the edges."""
    scale, inside = width / 2**0.5, 1 - math.exp(-3 * 2**0.5)
    rows = regressors(points, pairs, {"nuisance": partial(kernels.laplacian, reach=3 * width, scale=scale)})
    return rows.withColumn("nuisance", F.col("nuisance") * unit), per_source(points, F.lit(inside))


def gaussian_kernel(points: DataFrame, pairs: DataFrame, width: int, trial: int, unit: float) -> tuple[DataFrame, DataFrame]:
    """Within 5 widths; its integral loses the Normal tails that lie outside the trial."""
    return regressors(points, pairs, {"nuisance": gaussian(width, unit)}), gaussian_integral(points, width, trial)


def _gaussian_inside(width: int | Column, trial: int) -> Column:
    t = F.col("t_us")
    tail = lambda gap: F.when(gap <= 5 * width, norm_cdf(-gap / width)).otherwise(0.0)
    return 1 - 2 * norm_cdf(F.lit(-5.0)) - tail(t) - tail(trial - t)


def gaussian_integral(points: DataFrame, width: int, trial: int) -> DataFrame:
    return per_source(points, _gaussian_inside(width, trial))


def gaussian_integral_by_width(points: DataFrame, pairs: DataFrame, trial: int) -> DataFrame:
    """(src, dst, integral) of the Gaussian kernel of each pair's own width; a source's events are summed once a width."""
    wanted = pairs.select("src", "width").distinct()
    sums = points.withColumnRenamed("unit_id", "src").join(wanted, "src").groupBy("src", "width").agg(F.sum(_gaussian_inside(F.col("width"), trial)).alias("integral"))
    return pairs.select("src", "dst", "width").join(sums, ["src", "width"]).select("src", "dst", "integral")


def bspline_filter(points: DataFrame, pairs: DataFrame, inner: list[float], length: int, drop: int = 1) -> DataFrame:
    """(src, dst, trial_id, y_us, basis): sums of every spline basis over the delays in (0, length].

    ``inner``: knots on [0, 1] as shares of the length. The last ``drop`` bases are left out, so the filter ends at 0.
    y events without x in reach have no row. Trains meet as arrays (kernels.splines), not as joined events.
    """
    ts, k = np.array(inner), len(inner) + 2 - drop
    bases = [f"b{i}" for i in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.x is None:
                    continue
                n, sums = kernels.splines(r.x, r.cx, r.y, length, ts)
                met = np.flatnonzero(n)
                for i in range(0, len(met), HELD):
                    few = met[i : i + HELD]
                    yield pd.DataFrame({"src": r.src, "dst": r.dst, "trial_id": r.trial_id, "y_us": r.y[few]} | dict(zip(bases, sums[few].T)))

    rows = paired(points, pairs).mapInPandas(run, ", ".join(["src long, dst long, trial_id long, y_us long", *[f"{b} double" for b in bases]]))
    return rows.select(*KEYS, F.array(*bases).alias("basis"))


def centred(rows: DataFrame, means: DataFrame, name: str) -> DataFrame:
    """The regressor ``name`` less its mean over all time (src, mean), which makes its integral 0."""
    return rows.join(means.withColumnRenamed("mean", "__mean"), "src", "left").withColumn(name, F.col(name) - F.coalesce("__mean", F.lit(0.0))).drop("__mean")


def standard_design(points: DataFrame, pairs: DataFrame, n_trials: int, trial: int, length: int, width: int | None, unit: float, self_coupling: bool = False) -> DataFrame:
    """(src, dst, trial_id, y_us, w, const, nuisance, filter[, own]): constant, Gaussian nuisance, square filter.

    Nuisance and filter have mean 0 over all time, so the integrals are (n_trials x trial, 0, 0). ``own`` is y's
    coupling to itself by the same square filter, with mean 0 too. All columns of a pair's trial are made at once. Without
    a ``width`` for all, the pairs have a column of that name with their own, in microseconds.
    """
    area = n_trials * trial / unit
    mean = lambda integral: integral.select("src", (F.col("integral") / area).alias("mean"))
    named = {"nuisance": gaussian(width, unit) if width else gaussian_by_width(unit), "filter": square_filter(length)} | ({"own": own_square(length)} if self_coupling else {})
    rows = regressors(points, pairs, named).withColumn("const", F.lit(1.0))
    if width:
        rows = centred(rows, mean(gaussian_integral(points, width, trial)), "nuisance")
    else:
        own = gaussian_integral_by_width(points, pairs, trial).select("src", "dst", (F.col("integral") / area).alias("__mean"))
        rows = rows.join(own, ["src", "dst"], "left").withColumn("nuisance", F.col("nuisance") - F.coalesce("__mean", F.lit(0.0))).drop("__mean")
    filters = mean(square_integral(points, length, trial, unit))
    rows = centred(rows, filters, "filter")
    if self_coupling:
        rows = rows.join(filters.select(F.col("src").alias("dst"), F.col("mean").alias("__mean")), "dst").withColumn("own", F.col("own") - F.col("__mean"))
    return rows.select(*KEYS, "w", "const", *named)


def width_designs(points: DataFrame, pairs: DataFrame, n_trials: int, trial: int, length: int, widths: list[int], unit: float, self_coupling: bool = False) -> DataFrame:
    """The standard design for every kernel width at once: (src, dst, width, ..., const, nuisance, filter[, own])."""
    area = n_trials * trial / unit
    mean = lambda integral: integral.select("src", (F.col("integral") / area).alias("mean"))
    named = {f"n{w}": gaussian(w, unit) for w in widths} | {"filter": square_filter(length)} | ({"own": own_square(length)} if self_coupling else {})
    rows = centred(regressors(points, pairs, named).withColumn("const", F.lit(1.0)), mean(square_integral(points, length, trial, unit)), "filter")
    for w in widths:
        rows = centred(rows, mean(gaussian_integral(points, w, trial)), f"n{w}")
    own = ["own"] if self_coupling else []
    if own:
        of_y = mean(square_integral(points, length, trial, unit)).select(F.col("src").alias("dst"), F.col("mean").alias("__mean"))
        rows = rows.join(of_y, "dst").withColumn("own", F.col("own") - F.col("__mean"))
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("width"), F.col(f"n{w}").alias("nuisance")) for w in widths])).alias("e")
    return rows.select(*KEYS, "w", "const", "filter", *own, each).select(*KEYS, "w", "e.width", "const", "e.nuisance", "filter", *own)


def standard_columns(points: DataFrame, pairs: DataFrame, n_trials: int, trial: int, length: int, widths: list[int] | None, unit: float, self_coupling: bool = False) -> tuple[dict[str, Kernel], DataFrame]:
    """(kernels, pairs with ``means``) of the same designs for trains.whole and trains.blocks, which make no row an event: a
    nuisance for each of ``widths`` or, without any, for the pairs' own, then the filter, then y's own."""
    area, own = n_trials * trial / unit, ["own"] if self_coupling else []
    named = {f"n{w}": gaussian(w, unit) for w in widths} if widths else {"nuisance": gaussian_by_width(unit)}
    lost = F.when(F.col("t_us") > trial - length, length - (trial - F.col("t_us"))).otherwise(0)
    sums = points.groupBy(F.col("unit_id").alias("src")).agg(*[F.sum(_gaussian_inside(w, trial)).alias(f"n{w}") for w in widths or []], F.sum((length - lost) / unit).alias("filter"))
    known = pairs.join(sums, "src", "left")
    if not widths:
        known = known.join(gaussian_integral_by_width(points, pairs, trial).withColumnRenamed("integral", "nuisance"), ["src", "dst"], "left")
    if own:
        known = known.join(sums.select(F.col("src").alias("dst"), F.col("filter").alias("own")), "dst", "left")
    means = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) / area for c in [*named, "filter", *own]])
    named |= {"filter": square_filter(length)} | ({"own": own_square(length)} if own else {})
    return named, known.select(*pairs.columns, means.alias("means"))


def drives(points: DataFrame, others: DataFrame, n_trials: int, trial: int, width: int, unit: float) -> DataFrame:
    """(dst, trial_id, drive): the Gaussian kernel of all of a target's ``others`` (src, dst) together, less its mean over all time,
    at each of the target's instants, as one array in their order."""
    kernel, area = gaussian(width, unit), n_trials * trial / unit
    mean = others.join(gaussian_integral(points, width, trial), "src").groupBy("dst").agg((F.sum("integral") / area).alias("mean"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v = np.zeros(len(r.y)) if r.x is None else kernel(r.x, r.cx, r.y)
                yield pd.DataFrame({"dst": [r.dst], "trial_id": [r.trial_id], "src": [r.src], "v": [v]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.sort_values("src")
        return pd.DataFrame({"dst": one["dst"].iloc[:1], "trial_id": one["trial_id"].iloc[0], "v": [np.sum(one["v"].to_list(), axis=0)]})

    each = paired(points, others).mapInPandas(run, "dst long, trial_id long, src long, v array<double>")
    sums = each.groupBy("dst", "trial_id").applyInPandas(added, "dst long, trial_id long, v array<double>").join(mean, "dst", "left")
    known = packed_counts(points).join(sums, ["dst", "trial_id"], "left")
    at = F.coalesce("v", F.array_repeat(F.lit(0.0), F.col("m").cast("int")))
    less = F.coalesce("mean", F.lit(0.0))
    return known.select("dst", "trial_id", F.transform(at, lambda v: v - less).alias("drive"))


def packed_counts(points: DataFrame) -> DataFrame:
    """(dst, trial_id, m): how many instants a train has."""
    return points.groupBy(F.col("unit_id").alias("dst"), "trial_id").agg(F.count_distinct("t_us").alias("m"))


#: A kernel over bins: the first offset and the weights from there on.
BinKernel = tuple[int, np.ndarray]


def square_bins(length: int) -> BinKernel:
    """A square filter: the ``length`` bins after the event's own."""
    return 1, np.ones(length)


def triangle_bins(half: int) -> BinKernel:
    return -half, (half - np.abs(np.arange(-half, half + 1))) / float(half * half)


def gaussian_bins(width: float, reach: float = 5.0) -> BinKernel:
    half = round(reach * width)
    return -half, np.exp(-((np.arange(-half, half + 1) / width) ** 2) / 2) / math.sqrt(2 * math.pi) / width


def packed_bins(bins: DataFrame) -> DataFrame:
    """(unit_id, trial_id, b, n): a train's bins with events and their counts as arrays."""
    one = bins.groupBy("unit_id", "trial_id").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("e"))
    return one.select("unit_id", "trial_id", F.col("e.bin").alias("b"), F.col("e.n").alias("n"))


def convolve(bins: DataFrame, named: dict[float, BinKernel], n_bins: int, key: str | None = None) -> DataFrame:
    """(unit_id, trial_id[, key], bin, value): bins times each kernel, inside the window, where an event is in reach.

    A train is one array and meets a kernel in one pass: no row is made for an event and an offset.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for name, (low, weights) in named.items():
                    value, reached = kernels.binned(r.b, r.n, n_bins, low, weights)
                    at = np.flatnonzero(reached)
                    yield pd.DataFrame({"unit_id": r.unit_id, "trial_id": r.trial_id, "key": float(name), "bin": at, "value": value[at]})

    rows = packed_bins(bins).mapInPandas(run, "unit_id long, trial_id long, key double, bin long, value double")
    return rows.withColumnRenamed("key", key) if key else rows.drop("key")


def unit_sums(bins: DataFrame, widths: list[float], length: int, n_bins: int) -> DataFrame:
    """(src, trial_id, width, sw, sww, swh, sh, shh): sums over a trial's bins of x smoothed at each width (w), of its square
    filter (h) and of their products."""
    square, smooth = square_bins(length), {w: gaussian_bins(w) for w in widths}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                h, _ = kernels.binned(r.b, r.n, n_bins, *square)
                for width, kernel in smooth.items():
                    w, _ = kernels.binned(r.b, r.n, n_bins, *kernel)
                    out.append((r.unit_id, r.trial_id, width, w.sum(), w @ w, w @ h, h.sum(), h @ h))
            yield pd.DataFrame(out, columns=["src", "trial_id", "width", "sw", "sww", "swh", "sh", "shh"])

    return packed_bins(bins).mapInPandas(run, "src long, trial_id long, width double, sw double, sww double, swh double, sh double, shh double")


def pair_sums(bins: DataFrame, pairs: DataFrame, widths: list[float], length: int, n_bins: int) -> DataFrame:
    """(src, dst, trial_id, width, swy, shy): sums of y's counts times w and h, in trials in which both have events.

    A source's train is smoothed once for a block of its targets.
    """
    packed, square, smooth = packed_bins(bins), square_bins(length), {w: gaussian_bins(w) for w in widths}
    sizes = pairs.groupBy("src").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    dealt = pairs.join(sizes, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("blocks")).alias("block"))
    y = packed.select(F.col("unit_id").alias("dst"), "trial_id", F.struct(F.col("unit_id").alias("dst"), "b", "n").alias("y"))
    x = packed.withColumnRenamed("unit_id", "src")
    met = dealt.join(y, "dst").groupBy("src", "trial_id", "block").agg(F.collect_list("y").alias("ys")).join(x, ["src", "trial_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                h, _ = kernels.binned(r.b, r.n, n_bins, *square)
                w = np.stack([kernels.binned(r.b, r.n, n_bins, *k)[0] for k in smooth.values()])
                for y in r.ys:
                    b, n = np.asarray(y["b"]), np.asarray(y["n"], float)
                    out += [(r.src, y["dst"], r.trial_id, width, s, h[b] @ n) for width, s in zip(widths, w[:, b] @ n, strict=True)]
            yield pd.DataFrame(out, columns=["src", "dst", "trial_id", "width", "swy", "shy"])

    return met.mapInPandas(run, "src long, dst long, trial_id long, width double, swy double, shy double")


#: How a jitter basis is made of x's counts: the mean of y's window, the chance of at least one event in a bin of it, or
#: the mean over the window's length around y, with the trial mirrored at its ends.
JITTERS = ("interval", "interval_binary", "basic")


def jitter_basis(b: np.ndarray, n: np.ndarray, n_bins: int, delta: int, kind: str) -> np.ndarray:
    """The basis of one train at every bin; ``delta`` bins a window."""
    dense = np.zeros(n_bins)
    np.add.at(dense, b, n)
    if kind == "basic":
        before, after = delta // 2 - (1 - delta % 2), delta // 2
        sums = kernels.running(np.pad(dense, (before, after), mode="symmetric"))
        return (sums[delta:] - sums[:-delta]) / delta
    count = np.bincount(b // delta, n, -(-n_bins // delta))
    value = {"interval": count / delta, "interval_binary": 1 - (1 - 1 / delta) ** count}[kind]
    return np.repeat(value, delta)[:n_bins]


def jitter_rows(bins: DataFrame, pairs: DataFrame, n_bins: int, delta: int, kind: str = "interval") -> DataFrame:
    """(src, dst, n_x, n_w, x, wx, w): y's events by x's count in their bin and the jitter basis there, equal rows as one; n_x
    and n_w are both regressors' sums over all bins of all trials.

    A source's basis is made once a trial for a block of its targets.
    """
    if kind not in JITTERS:
        raise ValueError(f"no such jitter: {kind}")
    packed = packed_bins(bins)
    sizes = pairs.groupBy("src").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    dealt = pairs.join(sizes, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("blocks")).alias("block"))
    y = packed.select(F.col("unit_id").alias("dst"), "trial_id", F.struct(F.col("unit_id").alias("dst"), "b", "n").alias("y"))
    x = packed.withColumnRenamed("unit_id", "src")
    met = dealt.join(y, "dst").groupBy("src", "trial_id", "block").agg(F.collect_list("y").alias("ys")).join(x, ["src", "trial_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                count, basis = np.zeros(n_bins), np.zeros(n_bins)
                if r.b is not None:
                    np.add.at(count, r.b, r.n)
                    basis = jitter_basis(np.asarray(r.b), np.asarray(r.n, float), n_bins, delta, kind)
                for y in r.ys:
                    b = np.asarray(y["b"])
                    out.append(pd.DataFrame({"src": r.src, "dst": y["dst"], "x": count[b], "wx": basis[b], "w": np.asarray(y["n"])}))
            if out:
                yield pd.concat(out).groupby(["src", "dst", "x", "wx"], as_index=False)["w"].sum()

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = [(float(np.sum(r.n)), jitter_basis(np.asarray(r.b), np.asarray(r.n, float), n_bins, delta, kind).sum()) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"src": pdf["unit_id"], "n_x": [s[0] for s in sums], "n_w": [s[1] for s in sums]})

    rows = met.mapInPandas(run, "src long, dst long, x double, wx double, w long").groupBy("src", "dst", "x", "wx").agg(F.sum("w").alias("w"))
    area = packed.mapInPandas(totals, "src long, n_x double, n_w double").groupBy("src").agg(F.sum("n_x").alias("n_x"), F.sum("n_w").alias("n_w"))
    return rows.join(area, "src").select("src", "dst", "n_x", "n_w", "x", "wx", "w")


def own_bins(bins: DataFrame, length: int, n_bins: int, n_trials: int) -> DataFrame:
    """(dst, trial_id, bin, own): y's coupling to itself on bins: its square filter of the ``length`` bins before, less its
    mean over all bins; bins that no event reaches are not rows, and stand at minus that mean."""
    h = convolve(bins, {0: square_bins(length)}, n_bins)
    mean = h.groupBy("unit_id").agg((F.sum("value") / (n_bins * n_trials)).alias("mean"))
    return h.join(mean, "unit_id").select(F.col("unit_id").alias("dst"), "trial_id", "bin", (F.col("value") - F.col("mean")).alias("own"), "mean")


def _centred_sums(sums: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Gram entries of centred columns, from plain sums over ``total`` bins."""
    c = F.col
    return sums.select(
        *keys, "width", (c("sww") - c("sw") ** 2 / total).alias("s_ww"), (c("swh") - c("sw") * c("sh") / total).alias("s_wh"), (c("shh") - c("sh") ** 2 / total).alias("s_hh"),
        (c("swy") - c("sw") * c("s_y") / total).alias("s_wy"), (c("shy") - c("sh") * c("s_y") / total).alias("s_hy"), "s_y",
    )


OWN_SUMS = ["sw", "sww", "swh", "sh", "shh"]


def gram(bins: DataFrame, pairs: DataFrame, widths: list[float], length: int, n_bins: int, n_trials: int) -> DataFrame:
    """(src, dst, width, s_ww, s_wh, s_hh, s_wy, s_hy, s_y): centred sums of products over all bins and trials.

    w: Gaussian-smoothed x; h: square filter of x; y: counts. The x-only sums are made once a unit, not once a pair;
    the y sums join only y's bins with events.
    """
    own = unit_sums(bins, widths, length, n_bins).groupBy("src", "width").agg(*[F.sum(c).alias(c) for c in OWN_SUMS])
    met = pair_sums(bins, pairs, widths, length, n_bins).groupBy("src", "dst", "width").agg(F.sum("swy").alias("swy"), F.sum("shy").alias("shy"))
    sy = bins.groupBy(F.col("unit_id").alias("dst")).agg(F.sum("n").alias("s_y"))
    every = own.join(pairs, "src").join(sy, "dst").join(met, ["src", "dst", "width"], "left").fillna(0.0, ["swy", "shy"])
    return _centred_sums(every, ["src", "dst"], F.lit(float(n_bins * n_trials)))


def pooled_width(bins: DataFrame, pairs: DataFrame, group: list[str], widths: list[float], length: int, n_bins: int, cells: int | None = None, seed: int = 0) -> DataFrame:
    """(group, width, gain, n_cells): for each group of pairs the kernel width with the highest plug-in log-likelihood of its
    (pair, trial) cells in which both trains have events, as if these were the trials of one pair.

    ``pairs``: src, dst and the columns of ``group``. All cells are summed, unless about ``cells`` in each group are asked for,
    which a hash picks. ``gain``: over the next best width. Ties go to the narrower width.
    """
    active = bins.groupBy("unit_id", "trial_id").agg(F.sum("n").alias("s_y"))
    picked = pairs.join(active.select(F.col("unit_id").alias("src"), "trial_id"), "src").join(active.withColumnRenamed("unit_id", "dst"), ["dst", "trial_id"])
    if cells is not None:
        share = picked.groupBy(*group).agg((cells / F.count("*")).alias("share"))
        picked = picked.join(share, group).where(uniform("src", "dst", "trial_id", seed) < F.col("share"))
    picked = picked.select(*group, "src", "dst", "trial_id", "s_y")
    some = bins.join(picked.select(F.col("src").alias("unit_id"), "trial_id").distinct(), ["unit_id", "trial_id"], "left_semi")
    own = picked.join(unit_sums(some, widths, length, n_bins), ["src", "trial_id"])
    met = own.join(pair_sums(bins, picked.select("src", "dst").distinct(), widths, length, n_bins), ["src", "dst", "trial_id", "width"])
    sums = met.groupBy(*group, "width").agg(*[F.sum(c).alias(c) for c in (*OWN_SUMS, "swy", "shy", "s_y")], F.count("*").alias("n_cells"))
    total = F.col("n_cells") * float(n_bins)
    curve = _gain(_centred_sums(sums, [*group, "n_cells"], total), F.col("s_y") / total, [*group, "n_cells"])
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_last("value"), "width")
    ranked = curve.withColumns({"place": F.row_number().over(order), "next": F.lead("value").over(order)})
    return ranked.where("place = 1").select(*group, "width", (F.col("value") - F.col("next")).alias("gain"), "n_cells")


def _gain(sums: DataFrame, mean_y: Column, keys: list[str], simple: bool = False) -> DataFrame:
    """(keys, width, value): b' H^-1 b / (2 mean y) from Gram sums."""
    c = F.col
    det = c("s_ww") * c("s_hh") - c("s_wh") ** 2
    full = (c("s_wy") ** 2 * c("s_hh") - 2 * c("s_wy") * c("s_hy") * c("s_wh") + c("s_hy") ** 2 * c("s_ww")) / F.when(det > 1e-9, det)
    value = (c("s_wy") ** 2 / F.when(c("s_ww") > 1e-9, c("s_ww")) if simple else full) / (2 * mean_y)
    return sums.select(*keys, "width", value.alias("value"))


def width_curve(sums: DataFrame, n_bins: int, n_trials: int, simple: bool = False) -> DataFrame:
    """(src, dst, width, gain): b' H^-1 b / (2 mean y) from Gram sums, 0 at each pair's best width.

    ``simple``: of the filter alone, s_hy^2 / s_hh after the nuisance is taken out of neither.
    """
    out = _gain(sums, F.col("s_y") / (n_bins * n_trials), ["src", "dst"], simple)
    return out.select("src", "dst", "width", (F.col("value") - F.max("value").over(Window.partitionBy("src", "dst"))).alias("gain"))


def best_width(curve: DataFrame) -> DataFrame:
    """(src, dst, width) with the highest gain; ties to the narrowest."""
    return curve.where("gain is not null").groupBy("src", "dst").agg(F.max_by("width", F.struct("gain", -F.col("width"))).alias("width"))


def l2_fit(sums: DataFrame, n_bins: int, n_trials: int) -> DataFrame:
    """(src, dst, width, beta0, beta_w, beta_h): least squares of y on [1, w, h] by the normal equations.

    As w and h are centred, beta0 is the mean of y.
    """
    c = F.col
    det = F.when(F.abs(c("s_ww") * c("s_hh") - c("s_wh") ** 2) > 1e-9, c("s_ww") * c("s_hh") - c("s_wh") ** 2)
    return sums.select(
        "src", "dst", "width", (c("s_y") / (n_bins * n_trials)).alias("beta0"),
        ((c("s_wy") * c("s_hh") - c("s_hy") * c("s_wh")) / det).alias("beta_w"), ((c("s_hy") * c("s_ww") - c("s_wy") * c("s_wh")) / det).alias("beta_h"),
    )


def l2_no_coupling(sums: DataFrame) -> DataFrame:
    """(src, dst, width, slope): least squares on the smoothed x alone."""
    return sums.select("src", "dst", "width", (F.col("s_wy") / F.when(F.col("s_ww") > 1e-9, F.col("s_ww"))).alias("slope"))
