"""A baseline of its own for every trial, and one filter height for all, for pairs of any number of trials and events.

Given a height, each trial's baseline is the least of a convex function of one number, found where the trial's events are.
What is left is a convex function of the height alone, whose slope and curvature (the Schur complement of the arrow-shaped
Hessian) are sums over trials: one aggregation a step for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import ENDLESS, UNSETTLED
from tidewell.operators.newton import beside
from tidewell.sources.shared import settle, written

PAIR = ["src", "dst"]


def baselines_at(height: np.ndarray, first: np.ndarray, w: np.ndarray, f: np.ndarray, trial: float, ridge: float) -> tuple[np.ndarray, ...]:
    """(baseline, slope, curvature, value) of many trials, each at its ``height``; a trial's events begin at ``first``.

    A baseline makes -sum w log(a + height f) + a trial + ridge a^2 / 2 least, by Newton steps that keep every intensity
    positive. Slope and curvature are those of the least value as a function of the height.
    """
    n = len(first)
    own = np.repeat(np.arange(n), np.diff(np.append(first, len(w))))
    add = lambda v: np.bincount(own, v, minlength=n)
    lift = height[own] * f
    a = add(w) / trial - np.minimum(np.minimum.reduceat(lift, first), 0)
    for _ in range(200):
        lam = a[own] + lift
        slope, curve = trial + ridge * a - add(w / lam), add(w / lam**2) + ridge
        size = np.abs(slope) / np.sqrt(curve)
        if (size < 1e-10).all():
            break
        a = a - np.where(size < 0.25, 1, 1 / (1 + size)) * slope / curve
    lam = a[own] + lift
    curve, border = add(w / lam**2) + ridge, add(w * f / lam**2)
    value = -add(w * np.log(lam)) + a * trial + 0.5 * ridge * a**2
    return a, -add(w * f / lam), add(w * f * f / lam**2) - border**2 / curve, value


def _next(r: dict, steps: int, epsilon: float) -> dict:
    """A pair's row after slope and curvature at its height: a Newton step that stays between what is known to be too low and too high."""
    h, slope, curve = r["h"], r["slope"], max(r["curve"], 1e-300)
    low, high = (h, r["high"]) if slope < 0 else (r["low"], h)
    move = slope / curve
    r = r | {"nll": r["value"], "low": low, "high": high}
    if abs(slope) < epsilon * np.sqrt(curve):
        return r | {"done": True, "converged": True, "note": None}
    if r["n_iter"] >= steps:
        return r | {"done": True}
    to = h - move
    if not low < to < high:
        to = (low + high) / 2 if np.isfinite(low) and np.isfinite(high) else h - np.sign(slope) * 2 * max(1.0, abs(h))
    return r | {"h": to, "n_iter": r["n_iter"] + 1}


def fit_baselines(design: DataFrame, trial: float, ridge: float = 0.01, steps: int = 100, epsilon: float = 1e-8) -> DataFrame:
    """(src, dst, filter, baselines (trial_id, value), nll, n_iter, converged, note): a baseline for each trial that has y
    events, with a ridge, and one filter height a pair.

    Where all y events of a pair lie to one side of the filter's mean no height is best: ``note`` says so, and there are no
    baselines. ``design``: src, dst, trial_id, w, filter. One trial's y events are a row.
    """
    rows = settle(design.groupBy(*PAIR, "trial_id").agg(F.collect_list("w").alias("w"), F.collect_list("filter").alias("f")))
    sides = rows.groupBy(*PAIR).agg(F.min(F.array_min("f")).alias("least"), F.max(F.array_max("f")).alias("most"))
    one_side = ((F.col("least") >= 0) & (F.col("most") > 0)) | ((F.col("most") <= 0) & (F.col("least") < 0))
    none, inf = F.lit(None), float("inf")
    state = written(sides.select(
        *PAIR, F.lit(0.0).alias("h"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"), none.cast("double").alias("nll"), F.lit(0).alias("n_iter"), F.lit(False).alias("converged"),
        F.when(one_side, ENDLESS).otherwise(UNSETTLED).alias("note"), one_side.alias("done"),
    ))
    n_pairs, columns = state.count(), state.columns
    schema = ", ".join(f"{c} {t}" for c, t in state.dtypes)

    def batch(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        sizes = pdf["w"].map(len).to_numpy()
        w, f = (np.concatenate(pdf[c].to_list()).astype(float) for c in ("w", "f"))
        return baselines_at(pdf["h"].to_numpy(float), np.cumsum(sizes) - sizes, w, f, trial, ridge)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, slope, curve, value = batch(pdf)
                yield pdf[PAIR].assign(slope=slope, curve=curve, value=value)

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r if r["done"] else _next(r, steps, epsilon) for r in pdf.to_dict("records")], columns=columns)

    while state.where("not done").limit(1).count():
        at = beside(rows, state.where("not done").select(*PAIR, "h"), PAIR, n_pairs).mapInPandas(measured, "src long, dst long, slope double, curve double, value double")
        sums = at.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("slope", "curve", "value")])
        state = written(state.join(sums, PAIR, "left").mapInPandas(moved, schema))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[[*PAIR, "trial_id"]].assign(value=batch(pdf)[0])

    found = state.where("converged").select(*PAIR, "h")
    each = beside(rows, found, PAIR, n_pairs).mapInPandas(placed, "src long, dst long, trial_id long, value double")
    listed = each.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("trial_id", "value"))).alias("baselines"))
    height = F.when(F.col("converged"), F.col("h")).alias("filter")
    return state.join(listed, PAIR, "left").select(*PAIR, height, "baselines", F.when(F.col("converged"), F.col("nll")).alias("nll"), "n_iter", "converged", "note")
