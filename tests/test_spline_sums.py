"""k2: sums of B-splines from running sums of powers, not over joined events."""

import numpy as np

from tidewell.functions import kernels, numeric
from tidewell.plans.catalog import QUERIES


def test_sums_are_those_over_all_pairs():
    rng, length, inner = np.random.default_rng(4), 3_600_000_000, numeric.knots(6, 1.0)
    x, y = np.unique(rng.integers(0, 24 * length, 2000)), np.unique(rng.integers(0, 24 * length, 900))
    y = np.unique(np.concatenate([y, x[:50], x[50:60] + length, x[60:70] + length + 1]))
    c = rng.integers(1, 4, len(x))
    n, got = kernels.splines(x, c, y, length, inner)
    for i in range(len(y)):
        d = y[i] - x
        inside = (d > 0) & (d <= length)
        assert n[i] == c[inside].sum()
        assert np.allclose(got[i], c[inside] @ numeric.bspline(inner, d[inside] / length) if inside.any() else 0.0, atol=1e-9)
    none = np.zeros(0, np.int64)
    assert kernels.splines(none, none, y, length, inner)[0].sum() == 0 and len(kernels.splines(x, c, none, length, inner)[1]) == 0


def test_no_two_events_are_a_row(spark, data):
    assert "slot" not in QUERIES["k2_bspline"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
