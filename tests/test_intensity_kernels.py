"""Late kernels of k29_intensity: running sums, not pairs of events."""

import numpy as np

from tidewell.functions import kernels


def test_ramps_are_the_sums_over_all_pairs():
    rng = np.random.default_rng(3)
    x, y = np.unique(rng.integers(0, 5000, 300)), np.sort(rng.integers(0, 5000, 200))
    c = rng.integers(1, 4, len(x))
    d = y[:, None] - x
    inside, up = (d > 250) & (d <= 750), (d - 250) / 500
    for rising, value in ((True, up), (False, 1 - up)):
        assert np.allclose(kernels.ramp(x, c, y, 250, 750, rising), np.where(inside, value, 0) @ c)
    none = np.zeros(0, np.int64)
    assert (kernels.ramp(none, none, y, 250, 750, True) == 0).all()


def test_no_pair_of_events_is_a_row(spark, data):
    from tidewell.plans.catalog import QUERIES

    plan = QUERIES["k29_intensity"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" not in plan and plan.count("MapInPandas") == 1
