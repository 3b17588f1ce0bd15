"""Designs made in the task that uses them give what rows of designs give, and take no more of a task for longer trains."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.numeric import newton_best
from tidewell.operators import design, fit, posterior, trains
from tidewell.plans import regressions as r
from tidewell.plans.catalog import LENGTH, WIDTH, Tables
from tidewell.sources.adapters import DAY, HOUR

WIDTHS = [HOUR, 2 * HOUR]


@pytest.fixture(scope="module")
def tables(spark, data):
    t = Tables(spark, data)
    t.points, t.units = fit.settle(t.points), fit.settle(t.units)
    t.pairs = fit.settle(t.pairs.where("src < 12 and dst > 40"))
    return t


def alike(one, two, keys):
    one, two = (d.toPandas().sort_values(keys, ignore_index=True) for d in (one, two))
    assert len(one) == len(two) > 0
    for c in set(one.columns) & set(two.columns):
        for a, b in zip(one[c], two[c], strict=True):
            a, b = (None if v is None or (np.ndim(v) == 0 and v != v) else v for v in (a, b))
            assert (a is None) == (b is None) and (a is None or a == b or np.allclose(np.array(a, float), np.array(b, float), rtol=1e-6, atol=1e-7)), (c, a, b)


@pytest.mark.parametrize("most", [fit.MOST_ROWS, 50])
def test_fits(tables, most):
    t, keys = tables, ["src", "dst", "width"]
    got = fit.standard_fits(t.points, t.pairs, t.n_trials, DAY, LENGTH, WIDTHS, r.UNIT, True, most).drop("hessian")
    rows = design.width_designs(t.points, t.pairs, t.n_trials, DAY, LENGTH, WIDTHS, r.UNIT, True)
    alike(got, fit.fit_by_key(rows, keys, [*r.COLUMNS, "own"], [*r.integral(t), 0.0]).drop("hessian"), keys)


def test_fits_with_a_width_a_pair(tables):
    t = tables
    own = t.pairs.withColumn("width", (F.col("dst") % 2 + 1) * HOUR)
    rows = design.standard_design(t.points, own, t.n_trials, DAY, LENGTH, None, r.UNIT)
    for most in (fit.MOST_ROWS, 50):
        got = fit.standard_fits(t.points, own, t.n_trials, DAY, LENGTH, None, r.UNIT, most_rows=most).drop("hessian")
        alike(got, fit.fit_by_key(rows, ["src", "dst"], r.COLUMNS, r.integral(t)).drop("hessian"), ["src", "dst"])


def test_memberships_with_drives(tables):
    t = tables
    shares = dict.fromkeys(range(5), 0.2)
    others = t.units.select(F.col("unit_id").alias("dst"), "probe").join(t.units.select(F.col("unit_id").alias("src"), "probe"), "probe").where("dst <> src").select("src", "dst")
    rows, area = design.gaussian_kernel(t.points, others, WIDTH, DAY, r.UNIT)
    slow = rows.groupBy("dst", "trial_id", "y_us").agg(F.sum("nuisance").alias("drive"))
    mean = others.join(area, "src").groupBy("dst").agg((F.sum("integral") / r.integral(t)[0]).alias("mean"))
    d = r.standard(t).join(slow, ["dst", "trial_id", "y_us"], "left").join(mean, "dst", "left").withColumn("nuisance", F.col("nuisance") + F.col("drive") - F.col("mean"))
    drives = design.drives(t.points, others, t.n_trials, DAY, WIDTH, r.UNIT)
    keys = ["src", "dst", "group_id"]
    alike(r.member_nlls(t, r.group_heights(), shares, drives), fit.membership_nlls(d, r.group_heights(), shares, r.integral(t)[:2]), keys)
    alike(r.member_nlls(t, r.group_heights(), shares), fit.membership_nlls(r.standard(t), r.group_heights(), shares, r.integral(t)[:2]), keys)


def test_posteriors(tables):
    t = tables
    got = posterior.standard_posterior(t.points, t.pairs, t.n_trials, DAY, LENGTH, WIDTHS, r.UNIT, HOUR, samples=300, burn=50)
    rows = design.width_designs(t.points, t.pairs, t.n_trials, DAY, LENGTH, WIDTHS, r.UNIT).withColumn("width", F.col("width") / HOUR)
    alike(got, posterior.posterior(rows, r.COLUMNS, r.integral(t), samples=300, burn=50), ["src", "dst"])


def test_decay_rates(tables):
    t, rates = tables, np.geomspace(0.1, 30.0, 4)
    one, two = (fit.fit_exponential(t.points, t.pairs.where("src = 0"), DAY, r.UNIT, t.n_trials, 0.3, rates, most) for most in (fit.MOST_ROWS, 10))
    alike(one, two, ["src", "dst"])


@pytest.mark.parametrize("more", [{"steps": 8}, {"batch": fit.trial_batch(0.8), "flat": 1e-2, "steps": 1}])
def test_pooled_models(tables, more):
    t, keys = tables, ["group_id"]
    one, two = r.group_fits(t, *keys, **more), fit.pooled_fit(r.grouped_design(t), keys, r.COLUMNS, r.group_totals(t, *keys), **more)
    alike(one.drop("hessian"), two.drop("hessian"), keys)
    assert "batch" in more or one.where("converged").count() == 5


def test_longer_trains_take_more_tasks(tables, monkeypatch):
    t = tables
    few = trains.paired(t.points, t.pairs).rdd.getNumPartitions()
    monkeypatch.setattr(trains, "DEALT", 3000)
    assert trains.paired(t.points, t.pairs).rdd.getNumPartitions() > 4 * few


def test_a_fit_holds_little_beside_its_design():
    n, rng = 600_000, np.random.default_rng(3)
    x = np.column_stack([np.ones(n), rng.gamma(0.3, 1.0, (n, 2)) - 0.3])
    w = np.ones(n)
    tracemalloc.start()
    f = newton_best(x, w, np.array([50.0, 0.0, 0.0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert f["converged"] and peak < 3 * x.nbytes
