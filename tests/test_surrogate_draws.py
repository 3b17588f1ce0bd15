"""Surrogates are drawn in the task that counts them: no plan holds them, and events at one instant move together."""

import numpy as np
import pytest

from tidewell.functions import numeric
from tidewell.functions.columns import uniform
from tidewell.operators import ccg, trains


@pytest.fixture(scope="module")
def points(spark):
    rows = [(u, trial, t) for u in (0, 1) for trial in (0, 1) for t in (5, 5, 1700, 2999)]
    return spark.createDataFrame(rows, "unit_id long, trial_id long, t_us long")


def test_no_plan_holds_draws(spark, points):
    """A join's side that held them was broadcast by the size of the events, 200 times too small."""
    pairs = spark.createDataFrame([(0, 1)], "src long, dst long")
    made = trains.surrogate_ccg(points, pairs, 1000, 200, 50, 80, -3, 5), trains.surrogate_synchrony(points, pairs, 1000, 200, 25), trains.surrogate_fits(points, pairs, 1000, 200, 2, 4000, 500, 500, 1e3)
    for df in made:
        assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("basic", [False, True])
def test_draws_are_those_of_the_rows(points, basic):
    want = (ccg.basic_jitter if basic else ccg.interval_jitter)(points.where("unit_id = 1 and trial_id = 1"), 1000, 7).collect()
    got = trains.moved(1, 1, np.array([5, 1700, 2999]), 1000, range(1, 8), 0, basic)
    for rep in range(1, 8):
        drawn = sorted(r.t_us for r in want if r.rep == rep)
        assert drawn == sorted([got[rep - 1, 0], *got[rep - 1]])


def test_uniforms_are_the_columns(spark):
    want = spark.range(1).select(uniform(*map(int, (3, 4, 12345, 9, 0)))).first()[0]
    assert numeric.uniforms_of(["3/4/12345"], ["9/0"])[0, 0] == want
