"""Fitting linear-intensity models: per pair, pooled, with memberships; intensities and goodness of fit.

All fits take keys of any size. Fits of several sources are in operators.multivariate, baselines a trial in
operators.baselines, posteriors in operators.posterior.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import kernels
from tidewell.functions.columns import uniform
from tidewell.functions.numeric import newton_best
from tidewell.operators import design as designs
from tidewell.operators import trains
from tidewell.operators.newton import FIT, Columns, Packed, minimise
from tidewell.operators.testing import wald_p
from tidewell.sources.shared import settle


def _row(fit: dict) -> dict:
    whole = {"beta": None, "hessian": None} if fit["beta"] is None else {"beta": fit["beta"].tolist(), "hessian": fit["hessian"].tolist()}
    return whole | {k: fit[k] for k in ("nll", "n_iter", "converged", "note")}


#: Design rows of a key that one task fits; keys with more are fitted by sums, pass after pass.
MOST_ROWS = 2_000_000


def compress(design: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Equal design rows of a key are one row with their summed weight, so less reaches a fit."""
    return design.groupBy(*keys, *columns).agg(F.sum("w").alias("w"))


def fit_by_key(design: DataFrame, keys: list[str], columns: list[str], integral: list[float], most_rows: int = MOST_ROWS, **options) -> DataFrame:
    """(keys, beta, hessian, nll, n_iter, converged, note): the best fit for every key with every intensity positive.

    Column 0 is the constant; a fit starts at the key's mean rate. The first two keys, a pair, name a task's work: pairs of at
    most ``most_rows`` rows are fitted in a task each, with all further keys, larger ones by sums over Spark. The steps
    are the same either way, so the size of a key changes nothing. Where no rate
    is best - the y events all lie to one side of the columns' mean, and the likelihood rises without end - ``note``
    says so and there are no coefficients.
    """
    rows = settle(design.select(*keys, *columns, "w"))
    pair = keys[:2]
    sizes = rows.groupBy(*pair).agg(F.count("*").alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) <= most_rows:
        return _fit_groups(rows, keys, columns, integral, **options)
    large = sizes.where(F.col("size") > most_rows).select(*pair)
    some = settle(rows.join(large, pair, "left_semi"))
    totals = some.select(*keys).distinct().withColumn("total", _array(integral))
    return _fit_groups(rows.join(large, pair, "left_anti"), keys, columns, integral, **options).unionByName(newton_by_sums(some, keys, columns, totals, **options))


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _fit_groups(rows: DataFrame, keys: list[str], columns: list[str], integral: list[float], **options) -> DataFrame:
    kinds = dict(rows.dtypes)
    fields = ", ".join([*[f"{k} {kinds[k]}" for k in keys], FIT])
    total = np.array(integral, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [pdf] if len(keys) <= 2 else [own for _, own in pdf.groupby(keys[2:])]
        return pd.DataFrame([{k: own[k].iloc[0] for k in keys} | _row(newton_best(own[columns].to_numpy(float), own["w"].to_numpy(float), total, **options)) for own in each])

    return rows.groupBy(*keys[:2]).applyInPandas(run, fields)


def newton_by_sums(rows: DataFrame, keys: list[str], columns: list[str], totals: DataFrame,
                   batch: Callable[[DataFrame, int], DataFrame] | None = None, **options) -> DataFrame:
    """The same fits for keys of any size: a Newton step of all keys is one aggregation, or two while steps are long.

    ``totals``: keys, total (the integral, an array). ``batch``: the rows of a step, for training on samples of trials.
    """
    begun = rows.groupBy(*keys).agg(F.sum("w").cast("double").alias("n")).join(totals, keys)
    rate = F.concat(F.array(F.col("n") / F.col("total")[0]), _array([0.0] * (len(columns) - 1)))
    return minimise(Columns(rows, keys, columns, batch), keys, begun.select(*keys, "total", rate.alias("beta")), **options)


def by_size(points: DataFrame, pairs: DataFrame, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(pairs whose target has at most ``most_rows`` events, the others if there are any)."""
    n = points.groupBy(F.col("unit_id").alias("dst")).agg(F.count("*").alias("n"))
    if (n.agg(F.max("n")).first()[0] or 0) <= most_rows:
        return pairs, None
    large = n.where(F.col("n") > most_rows)
    return pairs.join(large, "dst", "left_anti"), pairs.join(large, "dst", "left_semi")


def standard_fits(points: DataFrame, pairs: DataFrame, n_trials: int, trial: int, length: int, widths: list[int] | None, unit: float, self_coupling: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """(src, dst, width, beta, hessian, nll, n_iter, converged, note): the standard design fitted to every pair, at each of
    ``widths`` or, without any, at the pairs' own.

    A pair's design is made in the task that fits it, from packed trains: no row is written, sent or kept for an event. Pairs
    whose target has more than ``most_rows`` events are fitted by sums over the design's rows, by the same steps.
    """
    small, large = by_size(points, pairs, most_rows)
    named, known = designs.standard_columns(points, small, n_trials, trial, length, widths, unit, self_coupling)
    n, total = len(widths or [0]), np.array([n_trials * trial / unit, 0.0, 0.0, 0.0][: 4 if self_coupling else 3])

    def made(pdf: pd.DataFrame) -> list[dict]:
        x, w = trains.whole(pdf, named)
        each = widths or [pdf["width"].iloc[0]]
        of = lambda i: x if n == 1 else x[:, [0, 1 + i, *range(1 + n, x.shape[1])]]
        return [{"width": width} | _row(newton_best(of(i), w, total)) for i, width in enumerate(each)]

    found = trains.by_pair(points, known, made, f"width long, {FIT}")
    if large is None:
        return found
    columns = ["const", "nuisance", "filter", *(["own"] if self_coupling else [])]
    if widths:
        rows = designs.width_designs(points, large, n_trials, trial, length, widths, unit, self_coupling)
    else:
        rows = designs.standard_design(points, large, n_trials, trial, length, None, unit, self_coupling).join(large.select("src", "dst", "width"), ["src", "dst"])
    return found.unionByName(fit_by_key(rows, ["src", "dst", "width"], columns, total.tolist(), most_rows).withColumn("width", F.col("width").cast("long")))


def inference(fits: DataFrame, index: int) -> DataFrame:
    """(src, dst, h, se, pval): coefficient ``index`` of three with its standard error from the inverse Hessian.

    The variance is a cofactor over the determinant; a Hessian without inverse gives none.
    """
    m = lambda i, j: F.col("hessian")[i][j]
    minor = lambda i, j: m((i + 1) % 3, (j + 1) % 3) * m((i + 2) % 3, (j + 2) % 3) - m((i + 1) % 3, (j + 2) % 3) * m((i + 2) % 3, (j + 1) % 3)
    det = m(0, 0) * minor(0, 0) + m(0, 1) * minor(0, 1) + m(0, 2) * minor(0, 2)
    scale = m(0, 0) * m(1, 1) * m(2, 2)
    var = minor(index, index) / F.when(det > 1e-12 * scale, det)
    found = fits.withColumn("h", F.col("beta")[index]).withColumn("se", F.sqrt(F.when(var > 0, var)))
    return found.select("src", "dst", "h", "se", wald_p(F.col("h"), F.col("se")).alias("pval"))


def nll_at(design: DataFrame, keys: list[str], columns: list[str], beta: DataFrame, integral: list[float]) -> DataFrame:
    """(keys, nll): -sum w ln(x beta) + beta.integral at given coefficients (keys, beta)."""
    joined = design.join(beta, keys)
    lam = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(columns)), F.lit(0.0))
    dot = sum((F.first("beta")[i] * v for i, v in enumerate(integral)), F.lit(0.0))
    return joined.withColumn("lam", lam).where("lam > 0").groupBy(*keys).agg((-F.sum(F.col("w") * F.ln("lam")) + dot).alias("nll"))


def gradient_at(design: DataFrame, keys: list[str], columns: list[str], beta: DataFrame, integral: list[float]) -> DataFrame:
    """(keys, g0, g1, ...): the gradient at given coefficients, which is 0 at a fit."""
    joined = design.join(beta, keys)
    lam = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(columns)), F.lit(0.0))
    sums = [(-F.sum(F.col("w") * F.col(c) / F.col("lam")) + integral[i]).alias(f"g{i}") for i, c in enumerate(columns)]
    return joined.withColumn("lam", lam).where("lam > 0").groupBy(*keys).agg(*sums)


def pooled_fit(design: DataFrame, keys: list[str], columns: list[str], totals: DataFrame, **options) -> DataFrame:
    """(keys, beta, hessian, nll, n_iter, converged, note) of pooled models - a group, a (trial, group), a (pair, group) -
    by newton_by_sums, however many rows a model or models there are."""
    return newton_by_sums(settle(design), keys, columns, totals, **options)


def pooled_blocks(blocks: DataFrame, keys: list[str], k: int, totals: DataFrame, batch: Callable[[DataFrame, int], DataFrame] | None = None, **options) -> DataFrame:
    """The same from designs in blocks (trains.blocks) of ``k`` coefficients: a step reads a row a block, not a row an event."""
    rows = settle(blocks)
    begun = rows.groupBy(*keys).agg(F.sum("n").alias("n")).join(totals, keys)
    start = begun.select(*keys, "total", F.concat(F.array(F.col("n") / F.col("total")[0]), _array([0.0] * (k - 1))).alias("beta"))
    return minimise(Packed(rows, keys, k, batch), keys, start, **options)


def trial_batch(share: float, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """A step's sample of trials, chosen by hash, with weights that make up for the rest."""
    return lambda rows, step: rows.where(uniform("trial_id", F.lit(step), seed) < share).withColumn("w", F.col("w") / share)


def membership_nlls(design: DataFrame, groups: dict[int, float], portions: dict[int, float], integral: list[float], most_rows: int = MOST_ROWS) -> DataFrame:
    """(src, dst, group_id, score): nll - ln(portion) of [const, nuisance] with each group's filter height held fixed.

    A group only changes the offset of the intensities. Pairs of at most ``most_rows`` design rows have all their groups
    fitted in a task, larger ones by sums with the group as a key: the same steps either way. Where all y events lie to
    one side of the nuisance's mean it has no best coefficient and is left out, for all groups alike.
    """
    total, columns, keys = np.array(integral, float), ["const", "nuisance"], ["src", "dst"]
    rows = settle(compress(design, keys, [*columns, "filter"]))
    sides = rows.groupBy(*keys).agg(F.count("*").alias("size"), ((F.min("nuisance") >= 0) | (F.max("nuisance") <= 0)).alias("one_side"))
    sides = settle(sides)
    rows = rows.join(sides, keys).withColumn("nuisance", F.when(F.col("one_side"), 0.0).otherwise(F.col("nuisance")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, f = pdf[columns].to_numpy(float), pdf["w"].to_numpy(float), pdf["filter"].to_numpy(float)
        nlls = [newton_best(x, w, total, offset=h * f)["nll"] for h in groups.values()]
        return pd.DataFrame({"src": pdf["src"].iloc[0], "dst": pdf["dst"].iloc[0], "group_id": list(groups), "nll": nlls})

    small = rows.where(F.col("size") <= most_rows).groupBy(*keys).applyInPandas(run, "src long, dst long, group_id int, nll double")
    if (sides.agg(F.max("size")).first()[0] or 0) > most_rows:
        each = F.explode(F.array(*[F.struct(F.lit(g).alias("group_id"), F.lit(float(h)).alias("height")) for g, h in groups.items()])).alias("g")
        large = settle(rows.where(F.col("size") > most_rows).select(*keys, *columns, "filter", "w", each).select(*keys, "g.group_id", *columns, (F.col("g.height") * F.col("filter")).alias("offset"), "w"))
        begun = large.groupBy(*keys, "group_id").agg((F.sum("w") / total[0] - F.least(F.min("offset"), F.lit(0.0))).alias("rate"))
        start = begun.select(*keys, "group_id", _array(integral).alias("total"), F.array(F.col("rate"), F.lit(0.0)).alias("beta"))
        small = small.unionByName(minimise(Columns(large, [*keys, "group_id"], columns, offset="offset"), [*keys, "group_id"], start).select(*keys, "group_id", "nll"))
    prior = F.element_at(F.create_map(*[F.lit(v) for g in groups for v in (g, float(np.log(portions[g])))]), F.col("group_id"))
    return small.select(*keys, "group_id", (F.col("nll") - prior).alias("score")).where("score is not null")


def standard_membership_nlls(points: DataFrame, pairs: DataFrame, n_trials: int, trial: int, length: int, width: int, unit: float, groups: dict[int, float], portions: dict[int, float],
                             drive: DataFrame | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """membership_nlls of the standard design, which is made in the task that fits a pair, from packed trains.

    ``drive``: dst, trial_id, drive - an array of what comes on top of the nuisance at each of y's instants, in their order. Pairs
    whose target has more than ``most_rows`` events go by the design's rows.
    """
    small, large = by_size(points, pairs, most_rows)
    named, known = designs.standard_columns(points, small, n_trials, trial, length, [width], unit)
    total = np.array([n_trials * trial / unit, 0.0])

    def made(pdf: pd.DataFrame) -> list[dict]:
        x, w = trains.whole(pdf, named)
        x, f = x[:, :2], x[:, 2]
        if "drive" in pdf.columns:
            x[:, 1] += np.concatenate(pdf["drive"].to_list())
        if x[:, 1].min() >= 0 or x[:, 1].max() <= 0:  # no best coefficient
            x[:, 1] = 0.0
        return [{"group_id": g, "score": newton_best(x, w, total, offset=h * f)["nll"]} for g, h in groups.items()]

    prior = F.element_at(F.create_map(*[F.lit(v) for g in groups for v in (g, float(np.log(portions[g])))]), F.col("group_id"))
    found = trains.by_pair(points, known, made, "group_id int, score double", drive)
    found = found.select("src", "dst", "group_id", (F.col("score") - prior).alias("score")).where("score is not null")
    if large is None:
        return found
    rows = designs.standard_design(points, large, n_trials, trial, length, width, unit)
    if drive is not None:
        y = trains.packed(points).select(F.col("unit_id").alias("dst"), "trial_id", F.col("ts").alias("y_us"))
        each = y.join(drive, ["dst", "trial_id"]).select("dst", "trial_id", F.explode(F.arrays_zip("y_us", "drive")).alias("e")).select("dst", "trial_id", "e.*")
        rows = rows.join(each, ["dst", "trial_id", "y_us"]).withColumn("nuisance", F.col("nuisance") + F.col("drive"))
    return found.unionByName(membership_nlls(rows, groups, portions, total.tolist(), most_rows))


def update_membership(pairs: DataFrame, scores: DataFrame, sample: bool = False, seed: int = 0) -> DataFrame:
    """(src, dst, group_id): each pair's group with the least score, or one drawn from exp(-score) by a hash.

    Pairs without scores, one of whose trains is empty, get null. Ties go to the smaller group.
    """
    w = Window.partitionBy("src", "dst")
    if sample:
        p = F.exp(F.min("score").over(w) - F.col("score"))
        upto = F.sum(p).over(w.orderBy("group_id")) / F.sum(p).over(w)
        hit = scores.withColumn("upto", upto).where(F.col("upto") > uniform("src", "dst", seed))
        best = hit.groupBy("src", "dst").agg(F.min("group_id").alias("group_id"))
    else:
        best = scores.groupBy("src", "dst").agg(F.min_by("group_id", F.struct("score", "group_id")).alias("group_id"))
    return pairs.join(best, ["src", "dst"], "left").select("src", "dst", "group_id")


def portions(membership: DataFrame, groups: int = 5) -> DataFrame:
    """(group_id, portion): (count + a_g) / sum, with a = all cells for each group but 1.1 times that for group 0."""
    n = membership.groupBy("group_id").agg(F.count("*").alias("n"))
    total = membership.agg(F.count("*").alias("total"))
    frame = membership.sparkSession.range(groups).select(F.col("id").cast("int").alias("group_id"))
    prior = F.when(F.col("group_id") == 0, 1.1).otherwise(1.0) * F.col("total")
    counted = frame.join(n, "group_id", "left").join(F.broadcast(total)).withColumn("v", F.coalesce("n", F.lit(0)) + prior)
    return counted.select("group_id", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias("portion"))


def _nearer(around: np.ndarray):
    """Each pair with its rate times each of ``around``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["src", "dst"]].loc[pdf.index.repeat(len(around))]
            yield out.assign(width=np.multiply.outer(pdf["rate"].to_numpy(), around).ravel())

    return run


#: Decay rates of the first round, and of each further one, between the neighbours of the best so far.
FIRST_RATES, MORE_RATES = np.geomspace(0.02, 2000.0, 24), 9


def fit_exponential(points: DataFrame, pairs: DataFrame, trial: int, unit: float, n_trials: int, precision: float = 5e-3, rates: np.ndarray = FIRST_RATES, most_rows: int = MOST_ROWS, **options) -> DataFrame:
    """(src, dst, beta0, alpha, rate, nll, n_iter, converged): intensity beta0 + alpha sum exp(-rate d), with the decay rate fitted too.

    In rounds: all pairs are fitted at all of a round's rates at once, each fit with every intensity positive. A pair's trains are
    one task's, which makes a rate's column, fits it and goes on to the next; pairs whose target has more than ``most_rows``
    events have a row an event and rate, with the rate as a key of the fits. The next round's rates lie between the neighbours of a pair's best one, until these
    are ``precision`` apart in ln(rate). ``converged``: the best rate is none at the ends of the first round's, and the fit
    has settled. Pairs without events of either unit are not in the result. Without a best fit at any rate they have nulls.
    """
    area = n_trials * trial / unit
    tried = pairs.select("src", "dst", F.explode(_array(rates.tolist())).alias("width"))
    found, gap, n = None, float(np.log(rates[1] / rates[0])), 0
    named = {"decay": trains.exponential_by_width(unit)}
    small, large = by_size(points, pairs.select("src", "dst"), most_rows)
    none, total = np.zeros(0, np.int64), np.array([area, 0.0])

    def made(pdf: pd.DataFrame) -> list[dict]:
        w, out = np.concatenate(pdf["cy"].to_list()).astype(float), []
        x = np.ones((len(w), 2))
        met = [(none, none, y) if xs is None else (xs, cx, y) for xs, cx, y in zip(pdf["x"], pdf["cx"], pdf["y"], strict=True)]
        for rate in pdf["means"].iloc[0]:
            x[:, 1] = np.concatenate([kernels.exponential(*trial_of, rate["width"], unit) for trial_of in met]) - rate["mean"]
            out.append({"width": rate["width"]} | _row(newton_best(x, w, total, **options)))
        return out

    while True:
        n += 1
        tried = settle(tried)
        rest = (trial - F.col("t_us")) / unit
        wanted = points.withColumnRenamed("unit_id", "src").join(tried.select("src", "width").distinct(), "src")
        mean = wanted.groupBy("src", "width").agg((F.sum((1 - F.exp(-F.col("width") * rest)) / F.col("width")) / area).alias("mean"))
        known = settle(tried.join(mean, ["src", "width"]))
        every = F.array_sort(F.collect_list(F.struct("width", "mean"))).alias("means")
        fits = trains.by_pair(points, known.join(small, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(every), made, f"width double, {FIT}")
        if large is not None:
            some = known.join(large, ["src", "dst"], "left_semi")
            rows = trains.regressors(points, some.select("src", "dst", "width"), named).join(mean, ["src", "width"])
            rows = rows.select("src", "dst", "width", F.lit(1.0).alias("const"), (F.col("decay") - F.col("mean")).alias("decay"), "w")
            fits = fits.unionByName(fit_by_key(rows, ["src", "dst", "width"], ["const", "decay"], [area, 0.0], most_rows, **options))
        fits = fits.join(known, ["src", "dst", "width"])
        beta0 = F.col("beta")[0] - F.col("beta")[1] * F.col("mean")
        here = fits.select("src", "dst", F.col("width").alias("rate"), beta0.alias("beta0"), F.col("beta")[1].alias("alpha"), "nll", "converged")
        every = here if found is None else found.unionByName(here)
        found = settle(every.groupBy("src", "dst").agg(F.min_by(F.struct("rate", "beta0", "alpha", "nll", "converged"), F.struct(~F.col("converged"), "nll", "rate")).alias("b")).select("src", "dst", "b.*"))
        if gap <= precision:
            break
        step = 2 * gap / (MORE_RATES + 1)
        around = np.exp(-gap + step * np.arange(1, MORE_RATES + 1))
        tried, gap = found.where("converged").select("src", "dst", "rate").mapInPandas(_nearer(around), "src long, dst long, width double"), step
    inside = (F.col("rate") > float(rates[0]) * (1 + precision)) & (F.col("rate") < float(rates[-1]) * (1 - precision))
    return found.select("src", "dst", "beta0", "alpha", F.when(F.col("converged"), F.col("rate")).alias("rate"), "nll", F.lit(n).alias("n_iter"), (F.col("converged") & inside).alias("converged"))


def reconstruct(fits: DataFrame, basis: list[list[float]]) -> DataFrame:
    """(src, dst, pos, h, se): filter and standard error on a grid, h = B beta and se = sqrt diag(B V B').

    ``fits``: src, dst, beta, cov (array of arrays); ``basis``: a row a grid point.
    """
    grid = F.array(*[F.array(*map(F.lit, row)) for row in basis])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = fits.select("src", "dst", "beta", "cov", F.posexplode(grid).alias("pos", "b"))
    var = dot(F.col("b"), F.transform("cov", lambda r: dot(r, F.col("b"))))
    return rows.select("src", "dst", "pos", dot(F.col("beta"), F.col("b")).alias("h"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"))


def time_rescaling(y_bins: DataFrame, intensity: DataFrame, keys: tuple[str, ...], seed: int = 0) -> DataFrame:
    """(keys, trial_id, t_us, u): 1 - exp(-integral) between successive y events, uniform if the model is right.

    ``y_bins``: keys, trial_id, t_us, bin of each event; ``intensity``: keys, trial_id, bin, lam (expected events per
    bin), dense. Bins between the two events' bins count whole; the later event's bin counts by a random share, as
    Haslinger's correction has it.
    """
    upto = Window.partitionBy(*keys, "trial_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    curve = intensity.select(*keys, "trial_id", "bin", "lam", F.sum("lam").over(upto).alias("area"))
    at = y_bins.join(curve, [*keys, "trial_id", "bin"])
    order = Window.partitionBy(*keys, "trial_id").orderBy("t_us")
    r = uniform(*keys, "trial_id", "t_us", seed)
    last = -F.ln(1 - r * (1 - F.exp(-F.greatest("lam", F.lit(-10.0)))))
    between = F.col("area") - F.col("lam") - F.lag("area").over(order)
    # both events in one bin: no whole bin lies between them
    tau = F.greatest(between, F.lit(0.0)) + last
    done = at.withColumn("tau", F.when(F.lag("area").over(order).isNotNull(), tau))
    return done.where("tau is not null").select(*keys, "trial_id", "t_us", (1 - F.exp(-F.least(F.col("tau"), F.lit(10.0)))).alias("u"))


def kernel_value(kind: str, d: Column, width: float, delay: float = 0.0) -> Column:
    """g(d) of a coupling kernel at a delay d, both in units; 0 outside its support."""
    e = d - delay
    inside = (e > 0) & (e <= width)
    value = {"square": F.lit(1.0), "triangle": 1 - e / width, "inverse_triangle": e / width, "exponential": F.exp(-e / width)}[kind]
    return F.when(e > 0, value).otherwise(0.0) if kind == "exponential" else F.when(inside, value).otherwise(0.0)


def bump(kind: str, d: Column, sigma: Column) -> Column:
    if kind == "laplacian":
        return F.exp(-F.abs(d) / sigma) / (2 * sigma)
    return F.exp(-d * d / (2 * sigma * sigma)) / (sigma * float(np.sqrt(2 * np.pi)))


def background(grid: DataFrame, peaks: DataFrame, kind: str, baseline: float, cutoff: float) -> DataFrame:
    """(trial_id, t, intensity): baseline plus a bump at every peak within ``cutoff`` of the grid point.

    grid: trial_id, t; peaks: trial_id, peak, sigma; joined by slots of the cutoff's width.
    """
    slot = lambda c: F.floor(c / cutoff)
    near = peaks.withColumn("slot", F.explode(F.sequence(slot(F.col("peak")) - 1, slot(F.col("peak")) + 1)))
    d = F.col("t") - F.col("peak")
    met = grid.withColumn("slot", slot(F.col("t"))).join(near, ["trial_id", "slot"]).where(F.abs(d) <= cutoff)
    sums = met.groupBy("trial_id", "t").agg(F.sum(bump(kind, d, F.col("sigma"))).alias("s"))
    return grid.join(sums, ["trial_id", "t"], "left").select("trial_id", "t", (baseline + F.coalesce("s", F.lit(0.0))).alias("intensity"))


def sinusoid(t: Column, baseline: float, amplitude: float, frequency: float, phase: float = 0.0) -> Column:
    return baseline + amplitude * F.sin(2 * float(np.pi) * frequency * t + phase)
