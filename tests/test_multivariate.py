"""Fits of several sources: the same in one block as by sums over blocks; their jitter test."""

import numpy as np
import pytest

from tidewell.operators import multivariate

BIN, BINS, WINDOW, TRIALS = 1000, 400, 20_000, 20


def trains_of(seed, planted):
    """Sources 1, 2, 3 and targets 8, 9; source 1 drives target 8 within the bin if ``planted``."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(TRIALS):
        x = {u: rng.integers(0, BIN * BINS, rng.poisson(30)) for u in (1, 2, 3, 8, 9)}
        if planted:
            x[8] = np.concatenate([x[8], x[1][rng.random(len(x[1])) < 0.3]])
        rows += [(u, k, int(t)) for u, ts in x.items() for t in ts]
    return rows


PAIRS = [(s, d) for d in (8, 9) for s in (1, 2, 3)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "src long, dst long")


def test_blocks_come_to_the_same(spark, pairs):
    p = spark.createDataFrame(trains_of(1, True), "unit_id long, trial_id long, t_us long")
    make = lambda block: multivariate.jitter_blocks(p, pairs, WINDOW, 12, BIN, BINS, TRIALS, True, block=block)
    one, many = make(10**9), make(4000)
    assert one.count() == 4 and many.count() > 20
    a, b = (multivariate.fit_blocks(x).toPandas().set_index(["dst", "rep"]).sort_index() for x in (one, many))
    assert len(a) == len(b) == 26 and (a.converged == b.converged).all() and (a.n_iter == b.n_iter).all() and a.converged.mean() > 0.8
    for x, y in zip(a[a.converged].itertuples(), b[b.converged].itertuples(), strict=True):
        assert np.allclose(x.beta, y.beta, atol=1e-8) and x.nll == pytest.approx(y.nll) and list(x.sources) == list(y.sources) == [1, 2, 3]
        assert np.allclose(np.array(list(x.hessian)).tolist(), np.array(list(y.hessian)).tolist(), rtol=1e-6)


def test_blocks_hold_the_counts(spark, pairs):
    rows = trains_of(5, False)
    p = spark.createDataFrame(rows, "unit_id long, trial_id long, t_us long")
    blocks = multivariate.jitter_blocks(p, pairs, WINDOW, 3, BIN, BINS, TRIALS, True).where("dst = 9 and chunk = 0").first()
    x = np.frombuffer(blocks.x, float).reshape(4, -1, 3, 2)
    count = lambda u: np.concatenate([np.bincount([t // BIN for v, k, t in rows if v == u and k == trial], minlength=BINS) for trial in range(TRIALS)])
    some = count(9) > 0
    assert np.array_equal(np.frombuffer(blocks.w, float), count(9)[some])
    for i, s in enumerate((1, 2, 3)):
        c = count(s)
        assert np.allclose(x[0, :, i, 1], (c - c.mean())[some])
        assert np.allclose(x[:, :, i, 0], (np.repeat(c.reshape(-1, 20).mean(axis=1), 20) - c.mean())[some])
        assert not np.allclose(x[1, :, i, 1], x[0, :, i, 1])


def test_a_plain_fit_of_any_block_size(spark):
    rng = np.random.default_rng(2)
    rows = [(d, k, t, 1 + (d + k + t) % 2, s, float(rng.gamma(2.0) - 2), float(rng.normal() * 0.1)) for d in (7, 8) for k in range(3) for t in range(200) for s in (1, 2, 5)]
    design = spark.createDataFrame(rows, "dst long, trial_id long, y_us long, w long, src long, a double, b double")
    one, many = (multivariate.fit_multivariate(design, ["a", "b"], [300.0, 0.0, 0.0], block).toPandas().sort_values("dst") for block in (10**6, 500))
    for x, y in zip(one.itertuples(), many.itertuples(), strict=True):
        assert x.converged and y.converged and np.allclose(x.beta, y.beta, atol=1e-8) and len(x.beta) == 7
    mine = design.where("dst = 7").toPandas().pivot_table(index=["trial_id", "y_us"], columns="src", values=["a", "b"])
    w = design.where("dst = 7 and src = 1").toPandas().w.to_numpy(float)
    x = np.column_stack([np.ones(len(mine)), *[mine[c, s] for s in (1, 2, 5) for c in ("a", "b")]])
    lam = x @ np.array(one.beta.iloc[0])
    assert (lam > 0).all() and np.allclose((w / lam) @ x, [300, *[0] * 6], atol=1e-4)


def test_jitter_test_finds_the_planted_source_and_no_other(spark, pairs):
    planted = multivariate.jitter_test(spark.createDataFrame(trains_of(1, True), "unit_id long, trial_id long, t_us long"), pairs, WINDOW, 99, BIN, BINS, TRIALS).toPandas().set_index(["src", "dst"])
    assert planted.p[1, 8] == 0.01 and planted.beta[1, 8] == pytest.approx(0.3 * 19 / 20, rel=0.4) and planted.ci_hi[1, 8] < planted.beta[1, 8]
    ps = list(planted.p.drop((1, 8)))
    for seed in range(2, 6):
        ps += list(multivariate.jitter_test(spark.createDataFrame(trains_of(seed, False), "unit_id long, trial_id long, t_us long"), pairs, WINDOW, 39, BIN, BINS, TRIALS).toPandas().p)
    ps = np.sort(ps)
    assert len(ps) == 29 and np.abs(ps - (np.arange(29) + 0.5) / 29).max() < 0.3 and (planted.n_fits == 99).all()
