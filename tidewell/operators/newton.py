"""Newton's method over Spark sums: fits of any number of rows, for many keys at once, that agree with those in a task.

A step of all keys is one aggregation of gradients and Hessians; while steps are long, one more evaluates the value at many
lengths at once. Coefficients are a DataFrame with one row a key; a k x k system is solved in that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import ENDLESS, LENGTHS, UNSETTLED, newton_length, newton_next
from tidewell.sources.shared import written

FIT = "beta array<double>, hessian array<array<double>>, nll double, n_iter int, converged boolean, note string"
#: Rows of coefficients that are broadcast to the design; beyond, both are joined by key.
MOST_KEYS = 20_000
#: Whole steps of a fit on batches; after them the t-th is a share of 1 / t, which averages the batches.
WHOLE = 3
STATE = "total array<double>, beta array<double>, hessian array<array<double>>, nll double, n_iter int, converged boolean, note string, done boolean, step array<double>, safe double"


def upper(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k)


def full(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[upper(k)] = values
    return out + np.triu(out, 1).T


def beside(rows: DataFrame, state: DataFrame, keys: list[str], n_keys: int) -> DataFrame:
    """Rows with their key's coefficients, which are broadcast if there are few."""
    return rows.join(F.broadcast(state) if n_keys <= MOST_KEYS else state, keys)


class Columns:
    """Designs with a column a coefficient: (keys, columns, w), and the column ``offset`` of every intensity, if there is one."""

    def __init__(self, rows: DataFrame, keys: list[str], columns: list[str], batch: Callable[[DataFrame, int], DataFrame] | None = None, offset: str | None = None) -> None:
        self.rows, self.keys, self.columns, self.batch, self.offset = rows, keys, columns, batch, offset

    def _at(self, state: DataFrame, n_keys: int, step: int) -> DataFrame:
        rows = self.rows if self.batch is None else self.batch(self.rows, step)
        return beside(rows, state, self.keys, n_keys).withColumn("lam", self._dot("beta") + (F.col(self.offset) if self.offset else 0.0))

    def _dot(self, name: str) -> Column:
        return sum((F.col(c) * F.col(name)[i] for i, c in enumerate(self.columns)), F.lit(0.0))

    def measure(self, state: DataFrame, n_keys: int, step: int) -> DataFrame:
        """(keys, a): least intensity, lightest row, events, -sum w ln(lam), gradient's sums, Hessian's upper triangle."""
        w, k = F.col("w"), len(self.columns)
        z = [F.col(c) / F.col("lam") for c in self.columns]
        sums = [F.min("lam"), F.min(w).cast("double"), F.sum(w).cast("double"), -F.sum(w * F.ln("lam"))]
        sums += [F.sum(w * z[i]) for i in range(k)] + [F.sum(w * z[i] * z[j]) for i, j in zip(*upper(k), strict=True)]
        return self._at(state.select(*self.keys, "beta"), n_keys, step).groupBy(*self.keys).agg(F.array(*sums).alias("a"))

    def search(self, state: DataFrame, n_keys: int, step: int) -> DataFrame:
        """(keys, b): sums of relative falls and of their sizes, then -sum w ln(lam) at each length (infinite where one is not
        positive), at the safe one and at none."""
        w = F.col("w")
        rows = self._at(state.select(*self.keys, "beta", "step", "safe"), n_keys, step).withColumn("fall", self._dot("step"))
        relative = w * F.col("fall") / F.col("lam")
        to = lambda s: F.col("lam") - s * F.col("fall")
        value = lambda s: F.sum(F.when(to(s) > 0, -w * F.ln(to(s))).otherwise(F.lit(float("inf"))))
        sums = [F.sum(F.greatest(relative, F.lit(0.0))), F.sum(F.abs(relative)), *[value(F.lit(x)) for x in LENGTHS], value(F.col("safe")), value(F.lit(0.0))]
        return rows.groupBy(*self.keys).agg(F.array(*sums).alias("b"))


class Packed:
    """Designs in blocks (keys, x, w), as trains.blocks makes them: a constant and ``k`` - 1 columns. A block's sums are made in
    one go, so a step reads no row an event."""

    def __init__(self, rows: DataFrame, keys: list[str], k: int, batch: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
        self.rows, self.keys, self.k, self.batch = rows, keys, k, batch

    def _sums(self, state: DataFrame, n_keys: int, step: int, of: Callable[..., np.ndarray], places: int, least: int, name: str) -> DataFrame:
        """Sums ``of(x, w, coefficients)`` over a key's blocks; the first ``least`` places are minima."""
        keys, k = self.keys, self.k
        rows = (self.rows if self.batch is None else self.batch(self.rows, step)).select(*keys, "x", "w")
        kinds = dict(rows.dtypes)
        values = [f"v{i}" for i in range(places)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = []
                for r in pdf.itertuples(index=False):
                    x = np.frombuffer(r.x, float).reshape(-1, k)
                    made.append([getattr(r, c) for c in keys] + of(np.column_stack([np.ones(len(x)), x[:, 1:]]), x[:, 0] * r.w, r).tolist())
                yield pd.DataFrame(made, columns=[*keys, *values])

        fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], *[f"{v} double" for v in values]])
        met = beside(rows, state, keys, n_keys).mapInPandas(run, fields)
        return met.groupBy(*keys).agg(F.array(*[(F.min if i < least else F.sum)(v) for i, v in enumerate(values)]).alias(name))

    def measure(self, state: DataFrame, n_keys: int, step: int) -> DataFrame:
        """As Columns.measure."""
        k = self.k

        def of(x: np.ndarray, w: np.ndarray, c) -> np.ndarray:
            lam = x @ np.asarray(c.beta)
            with np.errstate(invalid="ignore", divide="ignore"):
                z = x / lam[:, None]
                return np.concatenate([[lam.min(), w.min(), w.sum(), -(w * np.log(lam)).sum()], w @ z, ((z * w[:, None]).T @ z)[upper(k)]])

        return self._sums(state.select(*self.keys, "beta"), n_keys, step, of, 4 + k + k * (k + 1) // 2, 2, "a")

    def search(self, state: DataFrame, n_keys: int, step: int) -> DataFrame:
        """As Columns.search."""
        def of(x: np.ndarray, w: np.ndarray, c) -> np.ndarray:
            lam, fall = x @ np.asarray(c.beta), x @ np.asarray(c.step)
            relative, values = w * fall / lam, []
            for s in [*LENGTHS, c.safe, 0.0]:
                to = lam - s * fall
                values.append(-(w @ np.log(to)) if to.min() > 0 else np.inf)
            return np.array([np.maximum(relative, 0).sum(), np.abs(relative).sum(), *values])

        return self._sums(state.select(*self.keys, "beta", "step", "safe"), n_keys, step, of, len(LENGTHS) + 4, 0, "b")


def _measured(r: dict, steps: int, epsilon: float, flat: float | None) -> dict:
    """A key's row after its sums at its coefficients."""
    a, beta, total = np.array(r["a"], float), np.array(r["beta"], float), np.array(r["total"], float)
    k = len(beta)
    least, lightest, n, s_nll, g, h = a[0], a[1], a[2], a[3], a[4 : 4 + k], full(a[4 + k :], k)
    if not least > 0:  # rows of another batch: towards the constant rate, where all are positive
        rate = np.zeros(k)
        rate[0] = n / total[0]
        return r | {"beta": rate + 0.9 * rate[0] / (rate[0] - least) * (beta - rate), "n_iter": r["n_iter"] + 1, "done": r["n_iter"] >= steps, "step": None}
    value, share, steady = float(s_nll + beta @ total), 1.0, False
    if flat is not None and r["nll"] is not None and not np.isnan(r["nll"]):  # the mean over the batches so far
        value = r["nll"] + (value - r["nll"]) / (r["n_iter"] + 1)
        steady = abs(value - r["nll"]) <= flat * abs(value)
        share = 1 / max(1, r["n_iter"] - WHOLE + 1)
    what, step, safe = newton_next(total - g, h, n, lightest, epsilon)
    r = r | {"hessian": h, "nll": value, "step": None}
    if what == "end" or steady:
        return r | {"converged": True, "note": None, "done": True}
    if what == "endless":
        return r | {"note": ENDLESS, "done": True}
    if r["n_iter"] >= steps:
        return r | {"done": True}
    if what == "step" or share < 1:
        return r | {"beta": beta - (min(share, safe) if share < 1 else 1.0) * step, "n_iter": r["n_iter"] + 1}
    return r | {"step": step, "safe": safe, "n_iter": r["n_iter"] + 1}


def _searched(r: dict) -> dict:
    """A key's row after the values along its step."""
    b, beta, total, step = (np.array(r[c], float) for c in ("b", "beta", "total", "step"))
    lengths = np.array([*LENGTHS, r["safe"]])
    values = b[2:-1] + beta @ total - lengths * (step @ total)
    length = newton_length(values, lengths, float(b[-1] + beta @ total), float(step @ total), b[0], b[1])
    r = r | {"step": None}
    if length is None:
        return r | {"note": ENDLESS, "done": True}
    return r | ({"beta": beta - length * step} if length else {"done": True})


def _each(f: Callable[[dict], dict], only: Callable[[dict], bool], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                r = {c: None if isinstance(v, float) and v != v and c in ("a", "b", "step", "hessian", "note") else v for c, v in r.items()}
                r = f(r) if only(r) else r
                for c in ("hessian", "beta", "step", "total"):
                    if r[c] is not None:
                        r[c] = [list(map(float, x)) for x in r[c]] if c == "hessian" else list(map(float, r[c]))
                out.append([r[c] for c in columns])
            yield pd.DataFrame(out, columns=columns)

    return run


def minimise(design, keys: list[str], start: DataFrame, steps: int = 100, epsilon: float = 1e-7, flat: float | None = None) -> DataFrame:
    """(keys, beta, hessian, nll, n_iter, converged, note): for every key the least -sum w log(x b + offset) + b.total.

    ``start``: keys, total (integrals), beta (a constant first, at which every intensity is positive, then zeros). ``design``
    gives sums: measure() at coefficients, search() along steps. A fit ends when its step is below ``epsilon`` standard
    errors. For training on batches it ends when the mean of its batches' values changes by less than a share of ``flat``;
    after a few whole steps the t-th is a t-th of one. Fits without a least
    value, and those not settled after ``steps`` steps, have a note and no coefficients.
    """
    kinds = dict(start.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], STATE])
    columns = [*keys, *[f.split()[0] for f in STATE.split(", ")]]
    none = F.lit(None)
    state = written(start.select(
        *keys, "total", "beta", none.cast("array<array<double>>").alias("hessian"), none.cast("double").alias("nll"), F.lit(0).alias("n_iter"), F.lit(False).alias("converged"),
        F.lit(UNSETTLED).alias("note"), F.lit(False).alias("done"), none.cast("array<double>").alias("step"), none.cast("double").alias("safe"),
    ))
    n_keys = state.count()
    for step in range(steps + 2):
        met = design.measure(state.where("not done"), n_keys, step)
        # a key without rows in a batch waits for the next
        moved = _each(lambda r: _measured(r, steps, epsilon, flat), lambda r: not r["done"] and r["a"] is not None, columns)
        state = written(state.join(met, keys, "left").mapInPandas(moved, schema))
        left = state.agg(F.count_if(F.expr("not done")).alias("open"), F.count_if(F.expr("not done and step is not null")).alias("search")).first()
        if left.search:
            met = design.search(state.where("not done and step is not null"), n_keys, step)
            state = written(state.join(met, keys, "left").mapInPandas(_each(_searched, lambda r: r["b"] is not None, columns), schema))
        if not left.open:
            break
    found = lambda c: F.when(F.col("converged"), F.col(c)).alias(c)
    return state.select(*keys, found("beta"), found("hessian"), found("nll"), "n_iter", "converged", "note")
