"""Kernel widths: convolution of bins, the width of a probe pair, a width beside each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import kernels
from tidewell.operators import design, trains
from tidewell.plans import regressions as r
from tidewell.plans.catalog import BIN, QUERIES, Tables
from tidewell.sources.adapters import DAY, HOUR


@pytest.mark.parametrize("low, weights", [(1, np.ones(5)), (-3, np.arange(7.0)), (2, np.array([0.5])), (-40, np.ones(81)), (30, np.ones(3))])
def test_binned_like_every_offset(low, weights):
    rng = np.random.default_rng(1)
    b = np.sort(rng.choice(30, 8, replace=False))
    n = rng.integers(1, 4, 8)
    want, reach = np.zeros(30), np.zeros(30, bool)
    for x, c in zip(b, n, strict=True):
        for j, v in enumerate(weights):
            if 0 <= x + low + j < 30:
                want[x + low + j] += c * v
                reach[x + low + j] = True
    got, reached = kernels.binned(b, n, 30, low, weights)
    assert np.allclose(got, want) and (reached == reach).all()


def test_long_trains_by_fourier_transform():
    rng = np.random.default_rng(2)
    b, kernel = np.unique(rng.integers(0, 9000, 400)), design.gaussian_bins(100.0)
    got, _ = kernels.binned(b, np.ones(len(b)), 9000, *kernel)
    want = np.convolve(np.bincount(b, minlength=9000), kernel[1])[500:9500]
    assert 9000 * len(kernel[1]) > 4_000_000 and np.allclose(got, want, atol=1e-12)


def shared_background(seed, widths, trials=60, n_bins=600):
    """Units 1, 2 (probe a), 3, 4 (b), 5, 6 (c): a and b share bumps of the first width, a and c of the second."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(trials):
        rates = {}
        for name, width in zip("bc", widths, strict=True):
            peaks = rng.integers(0, n_bins, 8)
            at = np.arange(n_bins)
            rates[name] = sum(np.exp(-(((at - p) / width) ** 2) / 2) / width for p in peaks)
        for unit, rate in ((1, rates["b"]), (2, rates["c"]), (3, rates["b"]), (4, rates["b"]), (5, rates["c"]), (6, rates["c"])):
            n = rng.poisson(0.02 + 4 * rate)
            rows += [(unit, k, int(b), int(n[b])) for b in np.flatnonzero(n)]
    return rows


def test_probe_pairs_find_the_planted_widths(spark):
    bins = spark.createDataFrame(shared_background(3, (4, 40)), "unit_id long, trial_id long, bin long, n long")
    pairs = spark.createDataFrame([(1, 3, "narrow"), (1, 4, "narrow"), (2, 5, "wide"), (2, 6, "wide"), (1, 99, "none")], "src long, dst long, kind string")
    grid = [2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
    got = {x.kind: x for x in design.pooled_width(bins, pairs, ["kind"], grid, 3, 600, cells=90).collect()}
    assert set(got) == {"narrow", "wide"} and got["narrow"].width in (4.0, 8.0) and got["wide"].width in (32.0, 64.0)
    assert all(50 <= x.n_cells <= 120 and x.gain > 0 for x in got.values())
    whole = {x.kind: x.n_cells for x in design.pooled_width(bins, pairs, ["kind"], grid, 3, 600, cells=10**6).collect()}
    assert whole["narrow"] == 120 and whole["wide"] == 120


def test_pooled_sums_of_one_pair_are_its_own(spark):
    """All cells of one pair pooled choose as the pair's own curve does."""
    bins = spark.createDataFrame(shared_background(5, (4, 40)), "unit_id long, trial_id long, bin long, n long")
    pairs = spark.createDataFrame([(1, 3), (2, 5)], "src long, dst long")
    own = {(x.src, x.dst): x.width for x in design.best_width(design.width_curve(design.gram(bins, pairs, [2.0, 8.0, 32.0], 3, 600, 60), 600, 60)).collect()}
    pooled = {(x.src, x.dst): x.width for x in design.pooled_width(bins, pairs, ["src", "dst"], [2.0, 8.0, 32.0], 3, 600, cells=10**6).collect()}
    assert own == pooled and len(set(own.values())) == 2


def test_a_width_beside_each_pair(spark, data):
    t = Tables(spark, data)
    some = t.pairs.where("src < 4").withColumn("width", F.when(F.col("dst") % 2 == 0, F.lit(HOUR)).otherwise(F.lit(3 * HOUR)))
    keys = ["src", "dst", "trial_id", "y_us"]
    got = design.standard_design(t.points, some, t.n_trials, DAY, HOUR, None, r.UNIT).toPandas().sort_values(keys)
    for even, width in ((0, HOUR), (1, 3 * HOUR)):
        want = design.standard_design(t.points, some.drop("width").where(f"dst % 2 = {even}"), t.n_trials, DAY, HOUR, width, r.UNIT).toPandas().sort_values(keys)
        mine = got[got.dst % 2 == even]
        assert len(mine) == len(want) > 0 and all(np.allclose(mine[c], want[c]) for c in ("w", *r.COLUMNS))
    assert trains.paired(t.points, some).columns[-1] == "width"


def test_network_reports_its_widths(spark, data):
    got = QUERIES["w1_network"](spark, data).toPandas()
    grid = {w * BIN / HOUR for w in r.NETWORK_WIDTHS}
    assert got.width.isin(grid).all() and (got.groupby(["src_probe", "dst_probe"]).width.nunique() == 1).all() and got.width.nunique() > 1
