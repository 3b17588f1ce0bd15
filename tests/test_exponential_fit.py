"""The search for the decay rate of an exponential filter, against a grid of rates."""

from types import SimpleNamespace

import numpy as np

from tidewell.operators import fit
from tidewell.plans import regressions
from tidewell.plans.catalog import QUERIES
from tidewell.sources.adapters import DAY, HOUR

TRIALS = 30


def grid_nll(x, y, rate):
    """The least nll at a decay rate: Newton steps from the definition, with every delay."""
    f, area = [], 0.0
    for a, b in zip(x, y, strict=True):
        d = b[:, None] - a[None, :]
        f.append(np.where(d > 0, np.exp(-rate * np.maximum(d, 0)), 0).sum(axis=1))
        area += ((1 - np.exp(-rate * (24 - a))) / rate).sum()
    f, total = np.concatenate(f), np.array([24.0 * len(x), area])
    m, b = np.column_stack([np.ones(len(f)), f]), np.array([len(f) / total[0], 0.01])
    for _ in range(200):
        z = m / (m @ b)[:, None]
        step = np.linalg.solve(z.T @ z, total - z.sum(axis=0))
        while (m @ (b - step) <= 0).any():
            step /= 2
        b = b - 0.9 * step
    return -np.log(m @ b).sum() + b @ total


def test_fast_decay_is_found_and_reported(spark):
    rng, true = np.random.default_rng(3), 40.0
    x = [np.sort(rng.uniform(0, 23, 20)) for _ in range(TRIALS)]
    y = [np.sort(np.concatenate([rng.uniform(0, 24, 10), a + rng.exponential(1 / true, len(a))])) for a in x]
    points = [(u, k, int(s * HOUR)) for u, trains in ((1, x), (2, y)) for k, t in enumerate(trains) for s in t]
    t = SimpleNamespace(
        points=spark.createDataFrame(points, "unit_id long, trial_id long, t_us long"), pairs=spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"),
        trials=spark.range(TRIALS).withColumnRenamed("id", "trial_id"), n_trials=TRIALS,
    )
    got = regressions.k15(t).collect()
    assert [(r.src, r.dst) for r in got] == [(1, 2)] and got[0].converged and 0 < got[0].n_iter < 200
    assert abs(np.log(got[0].rate / true)) < 0.3
    in_task, by_sums = (fit.fit_exponential(t.points, t.pairs, DAY, float(HOUR), TRIALS, 0.2, np.geomspace(5, 300, 8), most_rows=m).first() for m in (10**6, 0))
    assert abs(by_sums.rate / in_task.rate - 1) < 1e-9 and abs(by_sums.nll - in_task.nll) < 1e-6 and abs(by_sums.alpha - in_task.alpha) < 1e-6
    assert got[0].nll <= min(grid_nll(x, y, r) for r in np.geomspace(0.5, 500, 40)) + 0.05


def test_every_pair_has_a_rate_or_none(spark, data):
    got = QUERIES["k15_exponential_fit"](spark, data).toPandas()
    some = got[got.converged]
    assert len(got) == 375 and len(some) > 100 and some.rate.between(0.02, 2000).all() and got.rate[got.beta0.isna()].isna().all()
