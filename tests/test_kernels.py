"""Sums of kernels in one pass against sums over all pairs of events."""

import numpy as np
import pytest

from tidewell.functions import kernels
from tidewell.operators import trains

DAY, WIDTH, HOUR = 86_400_000_000, 7_200_000_000, 3_600_000_000


@pytest.mark.parametrize(("n_x", "n_y"), [(0, 3), (1, 1), (40, 60), (255, 80), (400, 300), (3000, 500)])
def test_kernels_like_all_pairs(n_x, n_y):
    rng = np.random.default_rng(n_x)
    x = np.unique(rng.integers(0, DAY, n_x))
    c, y = rng.integers(1, 4, len(x)), rng.integers(0, DAY, n_y)
    y[: min(len(x), 5)] = x[:5][: len(y)]  # some at the same instant
    d = y[:, None] - x[None, :]

    def same(got, value, low, high):
        want = np.where((d > low) & (d <= high), value, 0) @ c
        assert np.allclose(got, want, rtol=1e-11, atol=1e-13 * max(1, n_x))

    same(kernels.count(x, c, y, 0, HOUR), 1, 0, HOUR)
    same(kernels.count(x, c, y, -HOUR, HOUR, 0.5), 0.5, -HOUR, HOUR)
    same(kernels.triangle(x, c, y, HOUR, 1e-9), (HOUR - abs(d)) * 1e-9, -HOUR, HOUR)
    same(kernels.exponential(x, c, y, 1.5, HOUR), np.exp(-1.5 * np.maximum(d, 0) / HOUR), 0, DAY)
    same(kernels.exponential_slope(x, c, y, 1.5, HOUR), -d / HOUR * np.exp(-1.5 * np.maximum(d, 0) / HOUR), 0, DAY)
    same(kernels.laplacian(x, c, y, 3 * WIDTH, WIDTH / 2**0.5) * HOUR, np.exp(-abs(d) / WIDTH * 2**0.5) / 2**0.5 / WIDTH * HOUR, -3 * WIDTH, 3 * WIDTH)
    for w in (WIDTH, WIDTH // 9):
        same(kernels.gaussian(x, c, y, w), np.exp(-((d / w) ** 2) / 2) / np.sqrt(2 * np.pi), -5 * w, 5 * w)
    inside = (y[:, None] // WIDTH) == (x[None, :] // WIDTH)
    assert np.allclose(kernels.window_count(x, c, y, WIDTH, 2.0), 2.0 * (inside @ c))


def test_exponentials_of_far_events_do_not_overflow():
    x = np.array([0, 10**6, 2_000 * 10**6])
    got = kernels.exponential(x, np.ones(3, int), np.array([2_001 * 10**6, 3_000 * 10**6]), 1.0, 1e6)
    assert np.allclose(got, [np.exp(-1.0), np.exp(-1000.0)])


def test_regressors_cover_every_y_event(spark):
    points = spark.createDataFrame([(1, 0, 10), (1, 0, 10), (1, 0, 20), (2, 0, 15), (2, 0, 15), (2, 0, 30), (2, 1, 5), (3, 0, 1)], "unit_id long, trial_id long, t_us long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "src long, dst long")
    got = trains.regressors(points, pairs, {"square": trains.square_filter(10), "own": trains.own_square(10)}).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 0, 15, 2, 2.0, 0.0), (1, 2, 0, 30, 1, 1.0, 0.0), (1, 2, 1, 5, 1, 0.0, 0.0), (2, 1, 0, 10, 2, 0.0, 0.0), (2, 1, 0, 20, 1, 2.0, 2.0)]


def test_surrogates_in_arrays_are_those_in_rows(spark):
    from pyspark.sql import functions as F

    from tidewell.operators import binning, ccg, synchrony

    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(int(u), int(k), int(t)) for u in range(4) for k in range(40) for t in rng.integers(0, 4000, 6)], "unit_id long, trial_id long, t_us long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (3, 0), (0, 8)], "src long, dst long")
    rows = ccg.interval_jitter(points, 1000, 7)
    want = ccg.ccg(binning.bins(points, 50), pairs, -3, 5, binning.bins(rows, 50, keys=("unit_id", "trial_id", "rep")), ("rep",))
    got = trains.surrogate_rows(trains.surrogate_ccg(points, pairs, 1000, 7, 50, 80, -3, 5), pairs, 7, -3, 5)
    key = lambda df: sorted((r.src, r.dst, r.rep, r.lag, r.raw) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 5 * 7 * 9
    for basic in (False, True):
        rows = (ccg.basic_jitter if basic else ccg.interval_jitter)(points, 1000, 7)
        want = {(r.src, r.dst, r.rep): r.n for r in synchrony.synchrony(points, pairs, 25, x_points=rows, keys=("rep",)).groupBy("src", "dst", "rep").agg(F.sum("n").alias("n")).collect()}
        got = trains.surrogate_rows(trains.surrogate_synchrony(points, pairs, 1000, 7, 25, basic), pairs, 7, 0, 0).withColumnRenamed("raw", "n").collect()
        assert all(r.n == want.get((r.src, r.dst, r.rep), 0) for r in got) and len(got) == 35
