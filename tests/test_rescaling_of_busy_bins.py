"""k27, k28: bins in which many events are expected, and values that stand on the grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import fit, testing


def test_busy_bins_count_whole(spark):
    lam = [30.0, 12.5, 0.5, 25.0]
    curve = spark.createDataFrame([(1, 2, 0, b, v) for b, v in enumerate(lam)], "src long, dst long, trial_id long, bin long, lam double")
    events = spark.createDataFrame([(1, 2, 0, t, t // 100) for t in (10, 110, 120, 310)], "src long, dst long, trial_id long, t_us long, bin long")
    got = {r.t_us: r.u for r in fit.time_rescaling(events, curve, ("src", "dst")).collect()}
    r = {x.t_us: x.r for x in events.select("t_us", fit.uniform("src", "dst", "trial_id", "t_us", 0).alias("r")).collect()}
    last = lambda t: -np.log(1 - r[t] * (1 - np.exp(-lam[t // 100])))
    for t, between in ((110, 0.0), (120, 0.0), (310, 0.5)):  # neighbouring bins have none between them
        assert got[t] == pytest.approx(1 - np.exp(-min(between + last(t), 10)), abs=1e-12)


def test_values_on_the_grid_are_counted_there(spark):
    for n in (20, 25, 40):
        values = spark.range(n + 1).select((F.col("id") / n).alias("p"))
        got = {r.bin: r.ecdf for r in testing.ecdf(values, n).collect()}
        assert [round(got[i] * (n + 1)) for i in range(1, n + 1)] == [sum(j / n <= i / n for j in range(n + 1)) for i in range(1, n + 1)]
