"""Surrogates meet all targets of their source at once, and are drawn once for them."""

import hashlib

import numpy as np
import pytest

from tidewell.functions import kernels, numeric
from tidewell.operators import trains
from tests.test_multivariate import BIN, BINS, TRIALS, trains_of

DAY, WIDTH, HOUR = 86_400_000_000, 7_200_000_000, 3_600_000_000


@pytest.mark.parametrize(("n_x", "n_y", "end", "width"), [(1, 3, DAY, WIDTH), (400, 3, DAY, WIDTH), (700, 900, DAY, WIDTH), (900, 700, 10_000, 77), (900, 700, 40_000_000, 500_000)])
def test_lines_meet_targets_like_all_pairs(n_x, n_y, end, width):
    rng = np.random.default_rng(n_x)
    y = np.unique(rng.integers(0, end, n_y))
    x = np.sort(rng.integers(-end // 10, end * 11 // 10, (3, n_x)), axis=1)  # also outside of the trial
    x[0, : min(n_x, len(y))] = (y[: min(n_x, len(y))] - 5 * width)  # exactly 5 widths apart
    x.sort(axis=1)
    c, targets = rng.integers(1, 4, x.shape), kernels.Targets(y, width)
    got, n = targets.gaussian(x, c), targets.count(x, c, width // 2)
    for i in range(3):
        d = y[:, None] - x[i]
        want = np.where((d > -5 * width) & (d <= 5 * width), np.exp(-((d / width) ** 2) / 2), 0.0) @ c[i] / np.sqrt(2 * np.pi)
        assert np.allclose(got[i], want, rtol=1e-12, atol=1e-14 * n_x)
        assert (n[i] == ((d > 0) & (d <= width // 2)) @ c[i]).all()


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_hashes_of_heads_and_tails_of_any_length(n):
    rng = np.random.default_rng(n)
    heads = [f"{u}/{int(10**t)}" for u, t in zip(rng.integers(0, 60, n), rng.uniform(0, 11, n), strict=True)] + ["9" * 44, "1" * 54, "2" * 120][: n // 30]
    tails = ["1/0", "200/0", "17/123456", "4" * 40]
    want = [[int(hashlib.md5(f"{h}/{t}".encode()).hexdigest()[:8], 16) / 2**32 for h in heads] for t in tails]
    assert (numeric.uniforms_of(heads, tails) == want).all() and (numeric.uniforms_of(heads[:n], tails[:3]) == np.array(want)[:3, :n]).all()
    assert numeric.uniforms_of([], tails).shape == (4, 0)


def test_a_source_is_drawn_once_for_its_targets(spark, monkeypatch, tmp_path):
    """It was drawn once for each 4 of them, and each target looked its x events up again."""
    rows = trains_of(6, True)
    p = spark.createDataFrame(rows + [(u, k, t) for u in range(50, 59) for _, k, t in rows[:200]], "unit_id long, trial_id long, t_us long")
    src = rows[0][0]
    pairs = spark.createDataFrame([(src, u) for u in range(50, 59)], "src long, dst long")
    drawn, log = trains.moved, str(tmp_path / "drawn")

    def counted(unit, trial_id, ts, width, reps, *more, **named):
        with open(log, "a") as f:
            f.writelines(f"{trial_id} {rep}\n" for rep in reps)
        return drawn(unit, trial_id, ts, width, reps, *more, **named)

    monkeypatch.setattr(trains, "moved", counted)
    got = trains.surrogate_fits(p, pairs, 20_000, 5, TRIALS, BIN * BINS, 10_000, 20_000, 1000.0).toPandas()
    assert len(got) == 9 * 6 and (got.groupby("dst").rep.nunique() == 6).all() and got.groupby("rep").h.agg(np.ptp).max() < 1e-9  # the same targets
    lines = open(log).read().splitlines()
    assert len(lines) == len(set(lines)) > 0 and {int(x.split()[1]) for x in lines} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize(("n_x", "n_y"), [(0, 5), (3, 0), (40, 60), (9000, 300)])
def test_steps_hold_what_is_near_each_train(n_x, n_y):
    rng = np.random.default_rng(n_x)
    ys = [np.unique(rng.integers(0, 20_000, n_y)) for _ in range(3)]
    cys = [rng.integers(1, 4, len(y)) for y in ys]
    x, c = np.sort(rng.integers(-500, 20_500, (4, n_x)), axis=1), rng.integers(1, 4, (4, n_x))
    got = kernels.Steps(ys, cys, 35).near(x, c)
    assert got.shape == (4, 3)
    for j, (y, cy) in enumerate(zip(ys, cys, strict=True)):
        for i in range(4):
            assert got[i, j] == c[i] @ (abs(x[i][:, None] - y) <= 35) @ cy


def test_jitter_p_shuffles_no_pair_of_trains(spark, data):
    """Its own count had each target's train sent once for every source; x is now counted beside its surrogates."""
    from tidewell.plans.catalog import QUERIES

    for name in ("f2_jitter_p", "f2_basic_jitter_p"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 3, name  # surrogates, their sums, p


def test_tables_of_any_size_count_alike(spark, monkeypatch):
    p = spark.createDataFrame(trains_of(6, True), "unit_id long, trial_id long, t_us long")
    pairs = spark.createDataFrame([(s, d) for s in (1, 2) for d in (3, 8, 9)], "src long, dst long")
    made = lambda: {(r.src, r.dst): bytes(r.n) for r in trains.surrogate_synchrony(p, pairs, 20_000, 30, 500, own=True).collect()}
    want = made()
    monkeypatch.setattr(trains, "TABLES", 1)
    monkeypatch.setattr(kernels, "LOOKED", 7)
    assert made() == want and len(want) == 6
    own = trains.totals(p, pairs, {"n": trains.met(-501, 500)}).groupBy("src", "dst").sum("n").collect()
    assert {(r.src, r.dst): r["sum(n)"] for r in own} == {k: np.frombuffer(v, "<i8")[0] for k, v in want.items()}
