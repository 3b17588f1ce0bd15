"""Posteriors of a pair's coefficients and kernel width, for pairs of any size, by an independence Metropolis chain.

Candidates are drawn first, from an approximation around the fits at a grid of widths; the likelihood at all of them is one
aggregation over the pair's events; the chain then runs over a short list of values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.numeric import newton_best
from tidewell.operators import design, trains
from tidewell.operators.fit import MOST_ROWS, by_size, fit_by_key
from tidewell.sources.shared import settle

#: Numbers that a block of events holds; intensities of events and candidates that are worked out at once.
BLOCK, AT_ONCE = 200_000, 500_000
#: Degrees of freedom of the candidates: their tails are heavier than a likelihood's.
DOF = 5


class Approximation:
    """Density of candidates (b, width): a width from a density that is linear between those of the grid, then Student's t
    around the fit there, with means and covariances between those of the neighbours."""

    def __init__(self, widths: np.ndarray, betas: np.ndarray, hessians: np.ndarray, nlls: np.ndarray, spread: float) -> None:
        order = np.argsort(widths)
        self.widths, self.betas = widths[order], betas[order]
        self.covs = spread * np.linalg.inv(hessians[order])
        log = -nlls[order] + 0.5 * np.linalg.slogdet(self.covs)[1]
        self.node = np.maximum(np.exp(log - log.max()), 1e-3)  # no stretch is left out
        self.areas = np.diff(self.widths) * (self.node[1:] + self.node[:-1]) / 2

    def at(self, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, covariance, log density of the width) at each width."""
        if len(self.widths) == 1:
            return np.repeat(self.betas, len(width), axis=0), np.repeat(self.covs, len(width), axis=0), np.zeros(len(width))
        i = np.clip(np.searchsorted(self.widths, width, "right") - 1, 0, len(self.widths) - 2)
        share = (width - self.widths[i]) / (self.widths[i + 1] - self.widths[i])
        mixed = lambda v: (1 - share).reshape(-1, *[1] * (v.ndim - 1)) * v[i] + share.reshape(-1, *[1] * (v.ndim - 1)) * v[i + 1]
        return mixed(self.betas), mixed(self.covs), np.log(mixed(self.node) / self.areas.sum())

    def draw(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``n`` candidates: coefficients, widths and the logarithm of their density, but for a constant."""
        if len(self.widths) == 1:
            width = np.full(n, self.widths[0])
        else:
            i, u = rng.choice(len(self.areas), n, p=self.areas / self.areas.sum()), rng.random(n)
            a, b = self.node[i], self.node[i + 1]
            root = np.sqrt(a * a + u * (b * b - a * a))
            share = np.where(np.abs(b - a) > 1e-9 * a, (root - a) / np.where(b == a, 1, b - a), u)
            width = self.widths[i] + np.clip(share, 0, 1) * (self.widths[i + 1] - self.widths[i])
        mean, cov, log_width = self.at(width)
        k = mean.shape[1]
        z = rng.standard_normal((n, k)) / np.sqrt(rng.chisquare(DOF, n) / DOF)[:, None]
        beta = mean + np.einsum("nij,nj->ni", np.linalg.cholesky(cov), z)
        log = log_width - 0.5 * np.linalg.slogdet(cov)[1] - (DOF + k) / 2 * np.log1p((z * z).sum(axis=1) / DOF)
        return beta, width, log


def chain(nll: np.ndarray, log: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(places, share accepted): the candidate that each step stands at, from the first with a likelihood on."""
    score = -nll - log
    at = int(np.argmax(np.isfinite(score)))
    places, moved, u = [], 0, np.log(rng.random(len(nll)))
    for i in range(len(nll)):
        if u[i] < score[i] - score[at]:
            at, moved = i, moved + 1
        places.append(at)
    return np.array(places), moved / len(nll)


def minus_logs(w: np.ndarray, still: np.ndarray, grid: np.ndarray, b: np.ndarray, at: np.ndarray, widths: np.ndarray, varying: int) -> np.ndarray:
    """-sum w log(intensity) of every candidate (b, at); infinite where an intensity is not positive.

    ``still``: the columns that do not change, in b's order, ``grid``: the one at place ``varying`` of b, at each of ``widths``.
    """
    mix = np.zeros((len(widths), len(at)))  # how much of each grid width a candidate's column is
    i = np.clip(np.searchsorted(widths, at, "right") - 1, 0, max(len(widths) - 2, 0))
    share = (at - widths[i]) / (widths[i + 1] - widths[i]) if len(widths) > 1 else np.zeros(len(at))
    mix[i, np.arange(len(at))] = 1 - share
    if len(widths) > 1:
        mix[i + 1, np.arange(len(at))] += share
    coef = np.vstack([np.delete(b, varying, axis=1).T, mix * b[:, varying]])
    sums, inside, step = np.zeros(len(at)), np.ones(len(at), bool), max(1, AT_ONCE // len(at))
    with np.errstate(invalid="ignore", divide="ignore"):
        for lo in range(0, len(w), step):
            s = slice(lo, lo + step)
            lam = np.hstack([still[s], grid[s]]) @ coef
            inside &= lam.min(axis=0) > 0
            sums += w[s] @ np.log(lam, out=lam)
    return np.where(inside, -sums, np.inf)


def walk(b: np.ndarray, at: np.ndarray, log: np.ndarray, v: np.ndarray, total: np.ndarray, burn: int, rng: np.random.Generator) -> dict:
    """The fields of a pair's posterior, from its candidates and their -sum w log(intensity)."""
    places, accepted = chain(v + b @ total, log, rng)
    kept = places[burn:]
    lo, hi = np.quantile(at[kept], [0.025, 0.975])
    return {"mean": b[kept].mean(axis=0).tolist(), "sd": b[kept].std(axis=0).tolist(), "width": at[kept].mean(), "width_sd": at[kept].std(), "width_lo": lo, "width_hi": hi, "accepted": accepted}


POSTERIOR = "mean array<double>, sd array<double>, width double, width_sd double, width_lo double, width_hi double, accepted double"


def standard_posterior(points: DataFrame, pairs: DataFrame, n_trials: int, trial: int, length: int, widths: list[int], unit: float, scale: float, samples: int = 2000, burn: int = 200, spread: float = 1.5, seed: int = 1,
                       most_rows: int = MOST_ROWS) -> DataFrame:
    """posterior() of the standard design at a grid of ``widths``, with the width in ``scale`` microseconds.

    A pair's design is made in a task, from packed trains, which fits it at each width, draws candidates and works out their
    likelihoods: no row is written or sent for an event. Pairs whose target has more than ``most_rows`` events go by the design's rows.
    """
    small, large = by_size(points, pairs, most_rows)
    named, known = design.standard_columns(points, small, n_trials, trial, length, widths, unit)
    n, total, nodes = len(widths), np.array([n_trials * trial / unit, 0.0, 0.0]), np.array(widths) / scale

    def made(pdf: pd.DataFrame) -> list[dict]:
        x, w = trains.whole(pdf, named)
        fits = [newton_best(x[:, [0, 1 + i, 1 + n]], w, total) for i in range(n)]
        if not all(f["converged"] for f in fits):
            return [dict.fromkeys(f.split()[0] for f in POSTERIOR.split(", "))]
        src, dst = int(pdf["src"].iloc[0]), int(pdf["dst"].iloc[0])
        near = Approximation(nodes, *[np.array([f[c] for f in fits]) for c in ("beta", "hessian", "nll")], spread)
        b, at, log = near.draw(samples, _rng(seed, src, dst))
        return [walk(b, at, log, minus_logs(w, x[:, [0, 1 + n]], x[:, 1 : 1 + n], b, at, nodes, 1), total, burn, _rng(seed + 1, src, dst))]

    found = trains.by_pair(points, known, made, POSTERIOR)
    if large is None:
        return found
    rows = design.width_designs(points, large, n_trials, trial, length, widths, unit).withColumn("width", F.col("width") / scale)
    return found.unionByName(posterior(rows, ["const", "nuisance", "filter"], total.tolist(), samples=samples, burn=burn, spread=spread, seed=seed))


def _rng(seed: int, src: int, dst: int) -> np.random.Generator:
    return np.random.default_rng([seed, src & (2**63 - 1), dst & (2**63 - 1)])


def posterior(rows: DataFrame, columns: list[str], integral: list[float], varying: str = "nuisance", samples: int = 2000, burn: int = 200, spread: float = 1.5, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(src, dst, mean, sd, width, width_sd, width_lo, width_hi, accepted): each pair's posterior of coefficients and kernel width.

    ``rows``: src, dst, trial_id, y_us, width, w, columns: the same events at every width of a grid, where only the column
    ``varying`` changes; between two widths it is interpolated. The prior is flat in the coefficients and in the width
    from the least of the grid to the largest; with a single width that is fixed. The first ``burn`` of ``samples`` steps
    are left out; widths have 2.5 and 97.5 % quantiles. ``accepted`` says how well the candidates fit: where it is small, the
    likelihood changes too much between neighbours of the grid, which should then be finer. Pairs without a best fit at some width have no posterior (nulls).
    """
    rows = settle(rows.select("src", "dst", "trial_id", "y_us", F.col("width").cast("double").alias("width"), "w", *columns))
    fits = fit_by_key(rows.select("src", "dst", "width", "w", *columns), ["src", "dst", "width"], columns, integral)
    named = fits.groupBy("src", "dst").agg(
        F.bool_and("converged").alias("whole"), F.array_sort(F.collect_list(F.struct("width", "beta", F.flatten("hessian").alias("hessian"), "nll"))).alias("fits")
    )
    found, k = settle(named.where("whole")), len(columns)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                width, beta, hessian, nll = (np.array([np.asarray(f[c], float) for f in r.fits]) for c in ("width", "beta", "hessian", "nll"))
                b, w, log = Approximation(width, beta, hessian.reshape(-1, k, k), nll, spread).draw(samples, _rng(seed, r.src, r.dst))
                yield pd.DataFrame([{"src": r.src, "dst": r.dst, "widths": width.tolist(), "b": b.tobytes(), "at": w.tobytes(), "log": log.tobytes()}])

    candidates = settle(found.mapInPandas(drawn, "src long, dst long, widths array<double>, b binary, at binary, log binary"))
    # a block: events by grid widths, beside the columns that do not change
    fixed = [c for c in columns if c != varying]
    one = rows.groupBy("src", "dst", "trial_id", "y_us").agg(
        F.first("w").cast("double").alias("w"), *[F.first(c).alias(c) for c in fixed], F.transform(F.array_sort(F.collect_list(F.struct("width", varying))), lambda s: s[varying]).alias("grid")
    )
    parts = one.groupBy("src", "dst").agg(F.ceil(F.sum(F.size("grid") + len(columns)) / block).alias("parts"))
    dealt = one.join(parts, ["src", "dst"]).withColumn("part", F.pmod(F.xxhash64("trial_id", "y_us"), F.col("parts")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([pdf["w"], *[pdf[c] for c in fixed], np.stack(pdf["grid"].to_list())]).astype(float)
        return pd.DataFrame([{"src": pdf["src"].iloc[0], "dst": pdf["dst"].iloc[0], "m": len(x), "x": x.tobytes()}])

    blocks = dealt.groupBy("src", "dst", "part").applyInPandas(pack, "src long, dst long, m long, x binary")

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, widths = np.frombuffer(r.x, float).reshape(r.m, -1), np.asarray(r.widths)
                b, at = np.frombuffer(r.b, float).reshape(-1, k), np.frombuffer(r.at, float)
                w, still, grid = x[:, 0], x[:, 1 : 1 + len(fixed)], x[:, 1 + len(fixed) :]
                out = minus_logs(w, still, grid, b, at, widths, columns.index(varying))
                yield pd.DataFrame({"src": r.src, "dst": r.dst, "i": np.arange(len(at)), "v": out})

    met = blocks.join(candidates.drop("log"), ["src", "dst"]).mapInPandas(valued, "src long, dst long, i int, v double")
    sums = met.groupBy("src", "dst", "i").agg(F.sum("v").alias("v")).groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    total = np.array(integral, float)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                b, at, log = np.frombuffer(r.b, float).reshape(-1, k), np.frombuffer(r.at, float), np.frombuffer(r.log, float)
                out.append({"src": r.src, "dst": r.dst} | walk(b, at, log, np.asarray(r.v), total, burn, _rng(seed + 1, r.src, r.dst)))
            yield pd.DataFrame(out)

    schema = f"src long, dst long, {POSTERIOR}"
    done = candidates.join(sums.select("src", "dst", F.col("s.v").alias("v")), ["src", "dst"]).mapInPandas(walked, schema)
    return named.select("src", "dst").join(done, ["src", "dst"], "left")
