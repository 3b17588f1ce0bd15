"""Hand-checked cases and laws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import numeric
from tidewell.operators import binning, ccg, design, fit, graph, synchrony, testing, timejoin, trains


def points(spark, rows):
    return spark.createDataFrame(rows, "unit_id long, trial_id long, t_us long")


def test_bins_are_half_open(spark):
    p = points(spark, [(1, 0, t) for t in (0, 100, 200, 1100, 5000, 6000)])
    got = {r.bin: r.n for r in binning.bins(p, 1000, 0, 4000).collect()}
    assert got == {0: 3, 1: 1}


def test_synchrony_of_one_and_two_trials(spark):
    y = [100, 200, 300, 399, 400, 401, 402]
    pairs = spark.createDataFrame([(1, 2)], "src long, dst long")
    one = points(spark, [(1, 0, 100), (1, 0, 400)] + [(2, 0, t) for t in y])
    assert [r.n for r in synchrony.synchrony(one, pairs, 20).collect()] == [5]
    z = [200, 300, 399, 400, 401, 402]
    two = points(spark, [(1, 0, 100), (1, 0, 400), (1, 1, 102), (1, 1, 401)] + [(2, r, t) for r in (0, 1) for t in z])
    assert sorted(r.n for r in synchrony.synchrony(two, pairs, 20).collect()) == [4, 4]


def test_delays_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), int(r), int(t)) for u in (1, 2) for r in range(3) for t in rng.integers(0, 1000, 40)]
    pairs = spark.createDataFrame([(1, 2)], "src long, dst long")
    for low, high in ((0, 50), (-30, 30), (-101, -7)):
        got = timejoin.pair_delays(points(spark, rows), pairs, low, high).count()
        want = sum(low < y - x <= high for u, r, x in rows if u == 1 for v, s, y in rows if v == 2 and s == r)
        assert got == want


def test_ccg_sign_and_mirror(spark):
    p = points(spark, [(1, 0, 10), (2, 0, 13)])
    b = binning.bins(p, 1)
    ab = {r.lag: r.raw for r in ccg.ccg(b, spark.createDataFrame([(1, 2)], "src long, dst long"), -4, 4).collect()}
    ba = {r.lag: r.raw for r in ccg.ccg(b, spark.createDataFrame([(2, 1)], "src long, dst long"), -4, 4).collect()}
    assert ab[3] == 1 and sum(ab.values()) == 1 and all(ab[k] == ba[-k] for k in ab)


def test_jitter_keeps_window_counts(spark):
    rng = np.random.default_rng(2)
    p = points(spark, [(1, 0, int(t)) for t in rng.integers(0, 10_000, 200)])
    moved = ccg.interval_jitter(p, 500, 3)
    window = F.floor(F.col("t_us") / 500)
    before = {r[0]: r[1] for r in p.groupBy(window).count().collect()}
    for rep in (1, 2, 3):
        assert {r[0]: r[1] for r in moved.where(F.col("rep") == rep).groupBy(window).count().collect()} == before


@pytest.mark.parametrize(("m", "delta", "n", "want"), [(2, 4, 2, (4 / 16, 10 / 16, 2 / 16)), (2, 5, 2, (9 / 25, 14 / 25, 2 / 25)), (2, 4, 3, (8 / 64, 38 / 64, 18 / 64)), (3, 4, 2, (1 / 16, 9 / 16, 6 / 16))])
def test_occupancy(m, delta, n, want):
    assert np.allclose(numeric.occupancy_pmf(m, delta, n), want)


def stirling(n, k):
    """Ways to part n things into k groups, none empty."""
    return 0 if n == 0 or k == 0 or k > n else 1 if k == n else stirling(n - 1, k - 1) + k * stirling(n - 1, k)


def test_occupancy_of_full_marks_counts_partitions():
    assert [stirling(*a) for a in ((3, 2), (4, 2), (4, 3), (5, 3))] == [3, 7, 6, 25]
    for n in range(1, 7):  # all bins marked: k bins are hit in ways falling(delta, k) x stirling(n, k)
        want = [math.perm(5, k) * stirling(n, k) / 5**n for k in range(min(5, n) + 1)]
        assert np.allclose(numeric.occupancy_pmf(5, 5, n), want)


def test_tails():
    assert abs(numeric.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(numeric.chi2_sf(9.487729036781154, 4) - 0.05) < 1e-9 and abs(numeric.chi2_sf(7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(numeric.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-8 and abs(numeric.t_sf2(0.5, 3) - 0.6514) < 1e-4
    assert abs(numeric.norm_ppf(0.975) - 1.959963984540054) < 1e-9 and numeric.poisson_ppf(0.5, 3.0) == 3
    assert abs(sum(numeric.binom_pmf(7, 0.3)) - 1) < 1e-12 and abs(numeric.poisson_cdf(2, 1.0) - 2.5 * math.exp(-1)) < 1e-12


def test_bsplines_add_up_to_one():
    b = numeric.bspline(numeric.knots(6, 1.0), np.linspace(0, 1, 50))
    assert b.shape == (50, 8) and np.allclose(b.sum(axis=1), 1)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.03, 1.0, None]
    rows = testing.adjust(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).orderBy("i").collect()
    known = sorted(x for x in p if x is not None)
    m = len(known)
    bh = {x: min(1.0, min(known[j] * m / (j + 1) for j in range(m) if known[j] >= x and j == max(k for k in range(m) if known[k] == known[j]))) for x in known}
    for r in rows[:-1]:
        assert r.bh == pytest.approx(bh[r.p]) and r.bonferroni == pytest.approx(min(1, r.p * m)) and r.bh <= r.by + 1e-12 and r.bh <= r.bonferroni + 1e-12
    assert rows[-1].bh is None


def test_contingency_of_a_known_table(spark):
    cells = [(1, 2, 3, 4, a, b, n) for a, b, n in ((0, 0, 10), (0, 1, 20), (1, 0, 30), (1, 1, 5))]
    r = testing.contingency_tests(spark.createDataFrame(cells, "src0 long, dst0 long, src1 long, dst1 long, cat0 int, cat1 int, n long")).first()
    t = np.array([[10, 20], [30, 5]])
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    assert r.dof == 1 and r.chi2 == pytest.approx((((np.abs(t - e) - 0.5) ** 2) / e).sum())


def test_smoothing_keeps_the_sum(spark):
    trace = spark.createDataFrame([("a", b, float(v)) for b, v in ((0, 3), (5, 1), (19, 2))], "k string, bin long, y double")
    got = binning.smooth(trace, ("k",), "y", 20, 2.0).toPandas()
    assert got["y"].sum() == pytest.approx(6.0) and got["bin"].between(0, 19).all()


def simulated(seed=3, trials=40, length=20_000_000, base=10.0, gain=20, lag=50_000):
    """x: Poisson; y: Poisson plus an echo of a share of x within lag."""
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(trials):
        x = np.sort(rng.integers(0, length, rng.poisson(base * length / 1e6)))
        y = rng.integers(0, length, rng.poisson(base * length / 1e6))
        keep = rng.random(len(x)) < gain / 100
        echo = x[keep] + rng.integers(1, lag, keep.sum())
        y = np.concatenate([y, echo[echo < length]])
        rows += [(1, r, int(t)) for t in x] + [(2, r, int(t)) for t in np.sort(y)]
    return rows


def test_fit_recovers_a_coupling(spark):
    trials, length, lag = 40, 20_000_000, 50_000
    p = points(spark, simulated())
    pairs = spark.createDataFrame([(1, 2)], "src long, dst long")
    d = design.standard_design(p, pairs, trials, length, lag, 500_000, 1e6)
    integral = [trials * length / 1e6, 0.0, 0.0]
    fits = fit.fit_by_key(d, ["src", "dst"], ["const", "nuisance", "filter"], integral)
    row = fits.first()
    assert row.converged and row.beta[2] == pytest.approx(0.2 / 0.05, rel=0.25)
    assert fit.inference(fits, 2).first().pval < 1e-4
    g = fit.gradient_at(d, ["src", "dst"], ["const", "nuisance", "filter"], fits.select("src", "dst", "beta"), integral).first()
    assert max(abs(g.g0), abs(g.g1), abs(g.g2)) < 1.0
    for most in (1, 10**6):  # by sums, and in one task
        again = fit.fit_by_key(d, ["src", "dst"], ["const", "nuisance", "filter"], integral, most_rows=most).first()
        assert np.allclose(again.beta, row.beta, atol=1e-9) and np.allclose(again.hessian, row.hessian) and (again.n_iter, again.converged, again.note) == (row.n_iter, True, None)
        assert again.nll == pytest.approx(row.nll)
    heights = trains.surrogate_fits(p, pairs, 100_000, 4, trials, length, lag, 500_000, 1e6).orderBy("rep").collect()
    assert [r.rep for r in heights] == [0, 1, 2, 3, 4] and heights[0].h == pytest.approx(row.beta[2], abs=1e-4) and all(r.converged for r in heights)
    moved = ccg.interval_jitter(p.where("unit_id = 1"), 100_000, 4).where("rep = 2").select("unit_id", "trial_id", "t_us")
    other = design.standard_design(moved.unionByName(p.where("unit_id = 2")), pairs, trials, length, lag, 500_000, 1e6)
    assert fit.fit_by_key(other, ["src", "dst"], ["const", "nuisance", "filter"], integral).first().beta[2] == pytest.approx(heights[2].h, abs=1e-4)


def test_degrees_count_neighbours_once(spark):
    units = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "unit_id long, probe string")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert {r.unit_id: r.degree for r in graph.degrees(units, edges).collect()} == {1: 1, 2: 1, 3: 0}


def test_stream_counts_like_a_batch(spark, tmp_path):
    from tidewell.streaming.counts import streaming_bins

    spark.sql("select cast(id % 3 as long) as unit_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts from range(50)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming_bins(stream).writeStream.format("memory").queryName("bins_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("bins_out").agg(F.sum("n")).first()[0] == 50
