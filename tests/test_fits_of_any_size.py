"""Fits come to the same in a task and by sums, and a fit without a best rate says so."""

import numpy as np
import pytest

from tidewell.functions.numeric import ENDLESS, newton_best
from tidewell.operators import fit
from tidewell.plans import regressions as r
from tidewell.plans.catalog import Tables


@pytest.fixture(scope="module")
def tables(spark, data):
    return Tables(spark, data)


@pytest.fixture(scope="module")
def made(tables):
    return fit.settle(r.standard(tables))


def test_every_pair_is_fitted_alike_in_a_task_and_by_sums(made, tables):
    one = fit.fit_by_key(made, ["src", "dst"], r.COLUMNS, r.integral(tables)).toPandas()
    two = fit.fit_by_key(made, ["src", "dst"], r.COLUMNS, r.integral(tables), most_rows=0).toPandas()
    some = fit.fit_by_key(made, ["src", "dst"], r.COLUMNS, r.integral(tables), most_rows=25).toPandas()
    assert 0 < one.converged.sum() < len(one) == len(two) == len(some) == 375
    for other in (two, some):
        both = one.merge(other, on=["src", "dst"])
        assert (both.converged_x == both.converged_y).all() and (both.note_x.fillna("") == both.note_y.fillna("")).all() and (both.n_iter_x == both.n_iter_y).all()
        best = both[both.converged_x]
        assert max(np.abs(np.array(a) - np.array(b)).max() for a, b in zip(best.beta_x, best.beta_y, strict=True)) < 1e-9
        assert np.allclose(best.nll_x, best.nll_y, rtol=1e-12) and both.beta_x[~both.converged_x].isna().all()
    assert set(one.note[~one.converged]) == {ENDLESS}


def test_pooled_fits_settle(made, tables):
    d = r.grouped_design(tables)
    fits = fit.pooled_fit(d, ["group_id"], r.COLUMNS, r.group_totals(tables, "group_id")).toPandas()
    assert fits.converged.all() and (fits.n_iter < 20).all()
    own = d.toPandas()
    for f in fits.itertuples():
        mine = own[own.group_id == f.group_id]
        x, w = mine[r.COLUMNS].to_numpy(float), mine.w.to_numpy(float)
        lam = x @ np.array(f.beta)
        total = r.group_totals(tables, "group_id").where(f"group_id = {f.group_id}").first().total
        assert (lam > 0).all() and np.allclose((w / lam) @ x, total, atol=1e-6 * w.sum())


def test_a_heavy_start_and_an_endless_one():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(5000), rng.gamma(0.3, 1.0, (5000, 2)) - 0.3])
    f = newton_best(x, np.ones(5000), np.array([50.0, 0, 0]))
    lam = x @ f["beta"]
    assert f["converged"] and (lam > 0).all() and np.allclose((1 / lam) @ x, [50, 0, 0], atol=1e-4)
    side = np.column_stack([np.ones(30), rng.random(30) + 0.1, rng.random(30) - 0.5])
    g = newton_best(side, np.ones(30), np.array([5.0, 0, 0]))
    assert not g["converged"] and g["note"] == ENDLESS and g["beta"] is None
    one = newton_best(np.array([[1.0, -0.2, -0.1]]), np.array([3.0]), np.array([5.0, 0, 0]))
    assert one["note"] == ENDLESS
    flat = newton_best(np.column_stack([np.ones(9), np.zeros(9)]), np.ones(9), np.array([3.0, 0]))  # a column that says nothing
    assert flat["converged"] and flat["beta"][0] == pytest.approx(3.0)
