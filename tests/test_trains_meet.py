"""c3, f1, f2: trains meet as arrays, so no row is made for two events that meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import synchrony, timejoin, trains
from tidewell.plans.catalog import QUERIES


def test_totals_are_those_of_the_joined_events(spark):
    rng = np.random.default_rng(5)
    rows = [(int(u), int(r), int(t)) for u in (1, 2, 3) for r in range(3) for t in rng.integers(0, 900, 60)] + [(1, 7, 5), (2, 8, 5)]
    points = spark.createDataFrame(rows, "unit_id long, trial_id long, t_us long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "src long, dst long")
    made = trains.totals(points, pairs, {"n": trains.met(-30, 70), "total": trains.delay(-30, 70)}).where("n > 0").collect()
    want = timejoin.pair_delays(points, pairs, -30, 70).groupBy("src", "dst", "trial_id").agg(F.count("*").alias("n"), F.sum("d").alias("total")).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, want))
    inside = synchrony.synchrony(points, pairs, 25, 200, 600).collect()
    brute = timejoin.pair_delays(points, pairs, -26, 25).where("x_us >= 200 and x_us < 600").groupBy("src", "dst", "trial_id").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, inside)) == sorted(map(tuple, brute))


@pytest.mark.parametrize("name", ["c3_delay_join", "f1_synchrony", "f2_jitter_p", "f2_basic_jitter_p"])
def test_no_two_events_are_a_row(spark, data, name):
    assert "slot" not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
