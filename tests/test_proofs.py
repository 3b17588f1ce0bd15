"""Queries that SQL can't express, on the smallest tables: against brute force, or at the point where they must stand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import numeric
from tidewell.operators import baselines, ccg, design, fit, graph, multivariate, posterior, series, synchrony, testing
from tests.test_operators import points, simulated
from tidewell.plans import correlograms, inference, regressions  # noqa: F401  they register their queries
from tidewell.plans.catalog import BIN, BINS, QUERIES, Tables
from tidewell.sources.adapters import DAY, HOUR

TRIALS, LENGTH, LAG = 40, 20_000_000, 50_000  # of the simulated trains
COLUMNS = ["const", "nuisance", "filter"]


@pytest.fixture(scope="module")
def driven(spark):
    """Points of x (1) driving y (2), and of a third unit."""
    return points(spark, simulated() + [(3, k, t) for u, k, t in simulated(seed=11) if u == 1]).persist()


@pytest.fixture(scope="module")
def rows(spark, data):
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, data).toPandas()
        return made[name]

    return get


@pytest.fixture(scope="module")
def events(spark, data):
    p = Tables(spark, data).points.toPandas()
    return {k: np.sort(g.t_us.to_numpy()) for k, g in p.groupby(["unit_id", "trial_id"])}


def integral_of(f, low, high, n=200_001):
    """By Simpson's rule."""
    x = np.linspace(low, high, n)
    w = np.ones(n)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * f(x)).sum() * (high - low) / (n - 1) / 3)


def poisson_above(n, mu):
    return 1 - sum(math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(n)) if mu > 0 else float(n <= 0)


def test_poisson_tails(rows):
    for r in rows("e10_poisson_test").sample(300, random_state=1).itertuples():
        assert r.p == pytest.approx(poisson_above(r.raw, r.mu), abs=1e-9) and poisson_above(r.raw + 1, r.mu) - 1e-9 <= r.p_rnd <= r.p + 1e-9
        assert 1 - poisson_above(int(r.ci_hi) + 1, r.mu) >= 0.975 - 1e-9 and (r.ci_hi == 0 or 1 - poisson_above(int(r.ci_hi), r.mu) < 0.975)
    got = rows("f3_tail_p")
    for r in got.sample(100, random_state=1).itertuples():
        q = min(1.0, r.mu / r.n_x)
        assert r.p_poisson == pytest.approx(poisson_above(r.s, r.mu), abs=1e-9)
        assert r.p_binomial == pytest.approx(sum(math.comb(r.n_x, k) * q**k * (1 - q) ** (r.n_x - k) for k in range(r.s, r.n_x + 1)), abs=1e-9)


def test_exact_null_like_drawing_every_event(spark):
    """Two windows: 3 events with 4 of 10 bins marked, 2 events with 1 of 10."""
    windows = spark.createDataFrame([(1, 2, 0, 0, 0, 4, 3), (1, 2, 0, 0, 1, 1, 2), (1, 2, 0, 1, 0, 4, 3)], "src long, dst long, lag int, trial_id long, window long, m long, n long")
    raw = spark.createDataFrame([(1, 2, 0, 4)], "src long, dst long, lag int, raw long")
    r = ccg.mass_test(raw, windows, 10).first()
    pmf = np.ones(1)
    for m, n in ((4, 3), (1, 2), (4, 3)):
        for _ in range(n):
            pmf = np.convolve(pmf, [1 - m / 10, m / 10])
    assert r.p == pytest.approx(pmf[4:].sum()) and r.mean == pytest.approx(2.6) and pmf[5:].sum() <= r.p_rnd <= r.p
    k = np.arange(17)
    for law, p in (("poisson", np.exp(k * math.log(2.6) - 2.6) / np.array([math.factorial(int(i)) for i in k])), ("normal", np.exp(-((k - 2.6) ** 2) / 2 / (6 * 0.24 + 2 * 0.09)))):
        p = np.where(p > 1e-12, p, 0) / p.sum()
        got = ccg.mass_test(raw, windows, 10, law).first()
        assert got.p == pytest.approx(p[4:].sum(), abs=1e-6) and got.mean == pytest.approx((p * k).sum(), abs=1e-4)


def test_named_tests_agree_where_they_must(rows):
    mass = rows("e14_mass_tests")
    assert set(mass.kind) == {"binom", "poisson", "poisson_pmf", "normal_pmf"} and (mass.groupby("kind").size() == 375 * 25).all()
    wide = mass.pivot_table(index=["src", "dst", "lag"], columns="kind", values="p")
    assert abs(wide.poisson - wide.poisson_pmf).max() < 1e-3 and abs(wide.binom - wide.poisson).max() < 0.2
    one = rows("e12_binom_test").set_index(["src", "dst", "lag"]).p
    assert np.allclose(one.loc[wide.index], wide.binom)
    mean = mass.pivot_table(index=["src", "dst", "lag"], columns="kind", values="mean")
    assert abs(mean.binom - mean.poisson).max() < 1e-9
    with pytest.raises(ValueError):
        ccg.pair_tests(None, None, ("other",), 1, 1, 0, 0, 1, 1)


def test_other_tails(rows):
    for r in rows("e22_correlation_p").itertuples():
        n = r.trials - 2
        t = abs(r.r) * math.sqrt(n / (1 - r.r**2))
        scale = math.gamma((n + 1) / 2) / math.sqrt(n * math.pi) / math.gamma(n / 2)
        assert r.p == pytest.approx(1 - 2 * integral_of(lambda x: scale * (1 + x * x / n) ** (-(n + 1) / 2), 0, t, 20_001), abs=1e-7)
    for r in rows("h3_contingency_p").sample(60, random_state=2).itertuples():
        if r.dof == 0:
            assert r.p == 1
        elif r.dof > 1:
            density = lambda x: np.maximum(x, 1e-300) ** (r.dof / 2 - 1) * np.exp(-x / 2) / 2 ** (r.dof / 2) / math.gamma(r.dof / 2)  # noqa: B023, E731
            assert r.p == pytest.approx(1 - integral_of(density, 0, r.chi2, 20_001), abs=1e-6)


def test_partial_correlations(rows, spark, data):
    e = np.stack(spark.read.parquet(f"{data}/embeddings.parquet").where("embedding is not null").toPandas().embedding.to_list()).astype(float)
    inv = np.linalg.inv(np.cov(e.T, bias=True))
    d = np.sqrt(np.diag(inv))
    got = rows("e23_partial_correlation").pivot_table(index="i", columns="j", values="r").to_numpy()
    assert np.allclose(got, -inv / np.outer(d, d), atol=1e-6)


def test_model_p_values(rows):
    got = rows("e18_model_p")
    exact = rows("e12_binom_test").groupby(["src", "dst"]).p.min()
    ratio = rows("f8_likelihood_ratio").set_index(["src", "dst"]).p
    at = list(zip(got.src, got.dst, strict=True))
    assert np.allclose(got.p_binom, exact.loc[at]) and np.allclose(got.p_lrt, ratio.loc[at], equal_nan=True) and got.p_beta.between(1 / 201 - 1e-9, 1).all()


def test_beta_laws(rows):
    got, poisson = rows("f6_beta_exact"), rows("f6_beta_poisson")
    assert got.p.between(0, 1 + 1e-9).all()
    closed = rows("f4_closed_beta").merge(rows("f5_closed_beta_mean"), on=["src", "dst"]).merge(poisson, on=["src", "dst"])
    assert np.allclose(closed.beta, closed.b1_cnt - closed.mean_cnt, atol=2e-6) and np.allclose(closed["mean"], 0, atol=1e-9)
    for r in closed.sample(50, random_state=1).itertuples():
        assert r.p == pytest.approx(poisson_above(r.s, r.mean_cnt * r.n_x), abs=1e-4)


def brute_rows(events, src, dst):
    """(w, x count in the bin, its window mean) of y's bins with events, over all trials."""
    out = []
    for k in range(30):
        x, y = (np.bincount(events.get((u, k), np.zeros(0, int)) // BIN, minlength=BINS)[:BINS] for u in (src, dst))
        window = np.repeat(x.reshape(-1, 48).sum(axis=1) / 48, 48)
        out += [(y[b], x[b], window[b]) for b in np.flatnonzero(y)]
    return np.array(out, float)


def flat(x, w, beta, total, tol=1e-3):
    """Whether the gradient of -sum w log(x b) + b.total is 0, beside its terms."""
    lam = x @ np.array(beta)
    return np.allclose((w / lam) @ x, total, rtol=tol, atol=tol)


def test_binned_regressions_stand_at_the_least(rows, events):
    linear, n = rows("f7_binned_regression"), {u: sum(len(t) for (v, _), t in events.items() if v == u) for u in {u for u, _ in events}}
    assert linear.converged.mean() > 0.3  # 26 events a pair: many likelihoods have no least value
    seen = 0
    for r in linear[linear.converged].sample(90, random_state=1).itertuples():
        b = brute_rows(events, r.src, r.dst)
        columns = {"B1": [1], "B0": [2], "B0B1": [2, 1]}[r.basis]
        x = np.column_stack([np.ones(len(b)), b[:, columns]])
        if (x @ np.array(r.beta) > 0).all():
            seen += 1
            assert flat(x, b[:, 0], r.beta, [BINS * 30, *[n[r.src]] * len(columns)])
            assert r.nll == pytest.approx(-(b[:, 0] * np.log(x @ np.array(r.beta))).sum() + np.dot(r.beta, [BINS * 30, *[n[r.src]] * len(columns)]), rel=1e-9)
    assert seen > 40
    both = linear.pivot_table(index=["src", "dst"], columns="basis", values="nll")
    lrt = rows("f8_likelihood_ratio").set_index(["src", "dst"]).loc[both.index]
    known = (both.B0 - both.B0B1).notna()
    assert known.sum() > 40 and (lrt.p.notna() == known).all() and (lrt.stat.notna() == known).all()
    lrt, both = lrt[known], both[known]
    assert np.allclose(lrt.stat, np.maximum(0, 2 * (both.B0 - both.B0B1)), atol=1e-6) and all(p == pytest.approx(math.erfc(math.sqrt(s / 2))) for p, s in zip(lrt.p, lrt.stat, strict=True))


def brute_basis(x, kind, delta=48):
    """A jitter basis of dense counts, bin by bin."""
    out = np.empty(len(x))
    for b in range(len(x)):
        if kind == "basic":
            near = [b + o for o in range(-(delta // 2) + (1 - delta % 2), delta // 2 + 1)]
            near = [-1 - k if k < 0 else 2 * len(x) - 1 - k if k >= len(x) else k for k in near]  # mirrored at the ends
            out[b] = x[near].sum() / delta
        else:
            c = x[b // delta * delta : (b // delta + 1) * delta].sum()
            out[b] = c / delta if kind == "interval" else 1 - (1 - 1 / delta) ** c
    return out


@pytest.mark.parametrize("kind", design.JITTERS)
@pytest.mark.parametrize("delta", [48, 7, 2])
def test_jitter_bases_like_brute_force(kind, delta):
    rng = np.random.default_rng(delta)
    b = np.sort(rng.choice(BINS, 40, replace=False))
    n = rng.integers(1, 4, 40)
    x = np.zeros(BINS)
    x[b] = n
    if kind == "basic" or BINS % delta == 0:
        assert np.allclose(design.jitter_basis(b, n.astype(float), BINS, delta, kind), brute_basis(x, kind, delta))


@pytest.mark.parametrize("name, kind", [("f7_interval_binary", "interval_binary"), ("f7_basic_jitter", "basic")])
def test_other_jitter_bases_stand_at_the_least(rows, events, name, kind):
    got = rows(name)
    assert set(got.basis) == {"B0", "B0B1"} and len(got) == 750
    for r in got[got.converged].sample(16, random_state=2).itertuples():
        score = np.zeros(len(r.beta))
        area = np.zeros(len(r.beta))
        for k in range(30):
            x, y = (np.bincount(events.get((u, k), np.zeros(0, int)) // BIN, minlength=BINS)[:BINS] for u in (r.src, r.dst))
            columns = np.stack([np.ones(BINS), brute_basis(x, kind), x][: len(r.beta)])
            area += columns.sum(axis=1)
            some = y > 0
            score += columns[:, some] @ (y[some] / (np.array(r.beta) @ columns[:, some]))
        assert np.allclose(score, area, rtol=1e-3, atol=1e-3)


def test_self_coupling_on_bins(spark):
    bins = spark.createDataFrame([(1, 0, 2, 1), (1, 0, 4, 2), (1, 0, 9, 1), (1, 1, 0, 1), (2, 0, 5, 1)], "unit_id long, trial_id long, bin long, n long")
    got = {(r.dst, r.trial_id, r.bin): (r.own, r["mean"]) for r in design.own_bins(bins, 3, 10, 2).collect()}
    mean = (3 + 6 + 0 + 3) / 20  # of the last event no later bin is left
    want = {(1, 0, b): v - mean for b, v in ((3, 1), (4, 1), (5, 3), (6, 2), (7, 2))} | {(1, 1, b): 1 - mean for b in (1, 2, 3)}
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == pytest.approx(want) and all(v[1] == pytest.approx(mean) for k, v in got.items() if k[0] == 1)


def test_band_around_a_table(spark):
    rng = np.random.default_rng(1)
    u = [("square", float(v)) for v in rng.random(4000) ** 2] + [("plain", float(v)) for v in rng.random(4000)]
    values = spark.createDataFrame(u, "k string, u double")
    root = spark.createDataFrame([(q / 37, math.sqrt(q / 37)) for q in range(38)], "q double, cdf double")
    assert {r.k: r.outside for r in testing.ks_outside(values, 20, ("k",)).collect()}["plain"] <= 1
    got = {r.k: r.outside for r in testing.ks_outside(values, 20, ("k",), null=root).collect()}
    assert got["square"] <= 2 and got["plain"] > 15
    grid = spark.createDataFrame([(v,) for v in (-0.5, 0.0, 0.1, 0.25, 0.7, 1.0, 3.0)], "at double")
    line = spark.createDataFrame([(0.0, 1.0), (0.2, 2.0), (1.0, 10.0)], "x double, y double")
    assert {r["at"]: r.y for r in testing.interpolated(grid, line, "x", "y", "at").collect()} == pytest.approx({-0.5: 1, 0: 1, 0.1: 1.5, 0.25: 2.5, 0.7: 7, 1: 10, 3: 10})


def test_exact_law_less_its_mean(rows, spark):
    """Two windows of 4 bins: 2 events of x with 1 of y's bins, 1 event with 2."""
    bins = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 3, 1), (1, 0, 5, 1), (2, 0, 3, 2), (2, 0, 5, 1), (2, 0, 6, 1)], "unit_id long, trial_id long, bin long, n long")
    pairs = spark.createDataFrame([(1, 2)], "src long, dst long")
    hit = 1 - 0.75**2
    law = np.convolve([1 - hit, hit], [0.5, 0.5])
    mean = hit + 0.5
    plain, less = (synchrony.beta_exact_test(bins, pairs, 4, c).first() for c in (False, True))
    assert plain.s == 2 and plain.beta == pytest.approx(2 / 3) and plain["mean"] == pytest.approx(mean / 3) and plain.p == less.p == pytest.approx(law[2])
    assert less.beta == pytest.approx((2 - mean) / 3) and less["mean"] == pytest.approx(0) and less.ci_hi == pytest.approx(plain.ci_hi - mean / 3)
    got = rows("f6_beta_exact_corrected").merge(rows("f6_beta_exact"), on=["src", "dst"])
    assert np.allclose(got["mean_x"], 0, atol=1e-9) and np.allclose(got.p_x, got.p_y) and (got.s_x == got.s_y).all()


def test_pooled_fits_of_a_pair_and_group(rows, spark, data):
    t = Tables(spark, data)
    got = rows("k12_pair_group_fits").set_index(["src", "dst", "group_id"])
    d = regressions.grouped_design(t).toPandas()
    assert len(got) == d.groupby(["src", "dst", "group_id"]).ngroups and (got.converged == got.note.isna()).all()
    cells = t.membership.where("group_id is not null").toPandas().groupby(["src", "dst", "group_id"]).size()
    for key in got[got.converged].sample(20, random_state=1).index:
        mine = d[(d.src == key[0]) & (d.dst == key[1]) & (d.group_id == key[2])]
        x, beta = mine[COLUMNS].to_numpy(float), np.array(got.beta[key])
        assert (x @ beta > 0).all() and np.allclose((mine.w / (x @ beta)) @ x, [24 * cells[key], 0, 0], atol=1e-3)


def test_rank_of_a_fit_among_surrogates(rows):
    fits = rows("k14_surrogate_fits")
    fits = fits[fits.converged]
    got = rows("h2_fit_rank_p").set_index(["src", "dst"])
    own = fits[fits.rep == 0].set_index(["src", "dst"]).h
    for key, g in fits[fits.rep > 0].groupby(["src", "dst"]):
        if key in own.index:
            q = (own[key] > g.h).mean()
            assert got.p[key] == pytest.approx(2 * min(q, 1 - q)) and got.h[key] == own[key]


def test_joint_jitter_query(rows):
    """26 events a pair are fewer than the coefficients of some targets: there is no best fit, and no p."""
    got = rows("f9_jitter_test")
    assert len(got) == 375 and (got.p.isna() == got.beta.isna()).all() and got.p.dropna().between(1 / 201 - 1e-12, 1).all()


def test_exponential_link_stands_at_the_least(rows, events):
    got = rows("f7_exponential_link").merge(rows("f4_closed_beta"), on=["src", "dst"])
    assert (got.converged == (got.s > 0)).all()  # without a coincidence no coefficient is low enough
    for r in got[got.converged].sample(20, random_state=3).itertuples():
        score = np.zeros(2)
        for k in range(30):
            x, y = (np.bincount(events.get((u, k), np.zeros(0, int)) // BIN, minlength=BINS)[:BINS] for u in (r.src, r.dst))
            d = y - np.exp(np.array(r.beta) @ np.stack([np.ones(BINS), x]))
            score += [d.sum(), (d * x).sum()]
        assert np.allclose(score, 0, atol=1e-4)


def test_multivariate_fits_stand_at_the_least(rows, spark, driven):
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long")
    d = design.standard_design(driven, pairs, TRIALS, LENGTH, LAG, 500_000, 1e6).select("src", "dst", "trial_id", "y_us", "w", "filter")
    r = multivariate.fit_multivariate(d, ["filter"], [TRIALS * LENGTH / 1e6, 0.0]).first()
    wide = d.toPandas().pivot_table(index=["trial_id", "y_us"], columns="src", values="filter")
    x = np.column_stack([np.ones(len(wide)), wide[1], wide[3]])
    w = d.where("src = 1").toPandas().set_index(["trial_id", "y_us"]).w.loc[wide.index].to_numpy(float)
    lam = x @ np.array(r.beta)
    assert r.converged and r.sources == [1, 3] and (lam > 0).all() and np.allclose((w / lam) @ x, [800.0, 0, 0], atol=0.5)
    assert r.beta[1] == pytest.approx(4, rel=0.25) and abs(r.beta[2]) < 0.6
    for name, most in (("k16_multivariate_fit", 1), ("f9_multivariate_regression", 2)):
        assert len(rows(name)) == 25 and all(len(r.beta) == 1 + most * len(r.sources) if r.converged else r.note for r in rows(name).itertuples())


def test_discrete_fits_stand_at_the_least(spark, data, rows, events):
    got = rows("k21_discrete_fit")
    assert len(got) == 375
    half = np.arange(-120, 121)
    gauss = np.exp(-((half / 24) ** 2) / 2) / math.sqrt(2 * math.pi) / 24
    count = lambda u, k: np.bincount(events.get((u, k), np.zeros(0, int)) // BIN, minlength=BINS)[:BINS]
    for r in got[got.converged].sample(12, random_state=5).itertuples():
        w = np.concatenate([np.convolve(count(r.src, k), gauss)[120 : 120 + BINS] for k in range(30)])
        h = np.concatenate([np.convolve(count(r.src, k), [0] + [1] * 12)[:BINS] for k in range(30)])
        y = np.concatenate([count(r.dst, k) for k in range(30)])
        x = np.column_stack([np.ones(len(y)), w - w.mean(), h - h.mean()])
        lam = x @ np.array(r.beta)
        if (lam[y > 0] > 0).all():
            assert np.allclose((y[y > 0] / lam[y > 0]) @ x[y > 0], [BINS * 30, 0, 0], atol=10)


def test_splines(rows, spark, data, events):
    """The bases of a filter, with the one that is left out, add up to one for every x event in reach."""
    got = rows("k2_bspline")
    for r in got.sample(200, random_state=1).itertuples():
        d = r.y_us - events[r.src, r.trial_id]
        d = d[(d > 0) & (d <= HOUR)] / HOUR
        want = numeric.bspline(numeric.knots(6, 1.0), d).sum(axis=0)
        assert np.allclose(r.basis, want[:-1]) and sum(r.basis) + want[-1] == pytest.approx(len(d))
    weights = numeric.bspline(numeric.knots(6, 1.0), np.arange(1, 13) / 12)[:, :-1]
    binned = rows("k20_discrete_bspline").set_index(["unit_id", "basis"]).s
    for u in (0, 13, 54):
        b = np.concatenate([t // BIN for (v, _), t in events.items() if v == u])
        want = sum(weights[o - 1] * (b + o < BINS).sum() for o in range(1, 13))
        assert np.allclose([binned.get((u, i), 0.0) for i in range(len(want))], want)


def test_self_coupling(rows, spark, data, events):
    got = rows("k10_self_coupling").set_index(["src", "dst"])
    for src, dst in ((0, 10), (3, 51), (12, 44)):
        own = [sum(((y - t > 0) & (y - t <= HOUR)).sum() for t in events[u, k]) for (u, k), y in events.items() if u == dst]
        y = np.concatenate([t for (u, _), t in events.items() if u == dst])
        mean = (np.minimum(HOUR, DAY - y) / HOUR).sum() / 720
        rows_ = sum(len(np.unique(t)) for (u, _), t in events.items() if u == dst)
        assert got.loc[src, dst].n == rows_ and got.loc[src, dst].s_own == pytest.approx(sum(own) - mean * rows_, abs=1e-6)


def test_trial_baselines(spark, driven, rows):
    d = design.standard_design(driven, spark.createDataFrame([(1, 2)], "src long, dst long"), TRIALS, LENGTH, LAG, 500_000, 1e6)
    r, own = baselines.fit_baselines(d, LENGTH / 1e6).first(), d.toPandas()
    base = {b["trial_id"]: b["value"] for b in r.baselines}
    lam = own.trial_id.map(base).to_numpy() + r.filter * own["filter"].to_numpy()
    assert r.converged and (lam > 0).all() and len(base) == TRIALS and r.filter == pytest.approx(4, rel=0.25)
    for k, a in base.items():
        here = (own.trial_id == k).to_numpy()
        assert (own.w[here] / lam[here]).sum() == pytest.approx(LENGTH / 1e6 + 0.01 * a, abs=1e-6)
    assert ((own.w * own["filter"]) / lam).sum() == pytest.approx(0, abs=1e-5)
    assert r.nll == pytest.approx(-(own.w * np.log(lam)).sum() + sum(a * LENGTH / 1e6 + 0.005 * a * a for a in base.values()))
    got = rows("k4_trial_blocks")
    assert len(got) == 375 and (got.converged == got.note.isna()).all() and (got.note.dropna() == numeric.ENDLESS).all() and got.converged.mean() > 0.5


def test_batches_come_near_the_whole_fit(rows):
    a, b = rows("k12_pooled_fit").set_index("group_id"), rows("k13_batch_fit").set_index("group_id")
    assert a.converged.all() and b.converged.all() and all(abs(a.beta[g][0] - b.beta[g][0]) < 0.12 * a.beta[g][0] for g in a.index)
    each = rows("k12_trial_group_fits")
    assert len(each) == len(each.drop_duplicates(["trial_id", "group_id"])) and each.converged.mean() > 0.9
    assert (each.converged == each.note.isna()).all() and (each.note.dropna() == numeric.ENDLESS).all()


def test_surrogate_heights(rows):
    got = rows("k14_surrogate_fits")
    assert (got.groupby(["src", "dst"]).size() == 201).all()
    own = got[got.rep == 0].merge(rows("k11_fit"), on=["src", "dst"])
    both = own[own.converged_x & own.converged_y]
    assert len(both) > 30 and np.median(abs(both.h - both.beta.str[2])) < 1e-3


def test_posteriors_stand_around_the_fit(spark, driven, rows):
    d = design.standard_design(driven, spark.createDataFrame([(1, 2)], "src long, dst long"), TRIALS, LENGTH, LAG, 500_000, 1e6)
    total = [TRIALS * LENGTH / 1e6, 0.0, 0.0]
    best = fit.fit_by_key(d, ["src", "dst"], COLUMNS, total).first()
    sd = np.sqrt(np.diag(np.linalg.inv(np.array([list(h) for h in best.hessian]))))
    many, one = (posterior.posterior(d.withColumn("width", F.lit(0.5)), COLUMNS, total, samples=3000, block=b).first() for b in (5000, 10**9))
    assert np.allclose(many.mean, one.mean) and many.accepted == one.accepted  # blocks change nothing
    assert (abs(np.array(one.mean) - best.beta) < 0.2 * sd).all() and (abs(np.array(one.sd) / sd - 1) < 0.15).all() and 0.3 < one.accepted < 1 and one.width == 0.5 and one.width_sd == 0
    se = fit.inference(fit.fit_by_key(d, ["src", "dst"], COLUMNS, total), 2).first().se
    assert se == pytest.approx(sd[2], rel=1e-6)
    for name in ("k18_posterior", "k18_posterior_fixed_width"):
        got = rows(name)
        some = got.dropna(subset="width")
        assert len(got) == 375 and len(some) > 200 and some.accepted.quantile(0.05) > 0.3 and some.width_lo.ge(1).all() and some.width_hi.le(8).all()


def test_posterior_covers_a_planted_width(spark):
    """y's rate follows x smoothed by a Gaussian of 0.4 s, on top of a constant."""
    rng, width, rows_ = np.random.default_rng(8), 0.4, []
    for k in range(60):
        x = np.sort(rng.random(30) * 20)
        t = rng.random(rng.poisson(20 * 60)) * 20
        rate = 1 + 3 * (np.exp(-(((t[:, None] - x) / width) ** 2) / 2) / width / math.sqrt(2 * math.pi)).sum(axis=1)
        y = t[rng.random(len(t)) < rate / 60]
        rows_ += [(1, k, int(v * 1e6)) for v in x] + [(2, k, int(v * 1e6)) for v in np.sort(y)]
    p, pair = points(spark, rows_), spark.createDataFrame([(1, 2)], "src long, dst long")
    grid = [100_000, 200_000, 300_000, 400_000, 500_000, 700_000, 1_000_000]
    d = design.width_designs(p, pair, 60, 20_000_000, 50_000, grid, 1e6).withColumn("width", F.col("width") / 1e6)
    r = posterior.posterior(d, COLUMNS, [1200.0, 0.0, 0.0], samples=4000).first()
    assert r.width_lo < 0.4 < r.width_hi and r.width == pytest.approx(0.4, abs=0.1) and r.width_sd < 0.1 and r.accepted > 0.2
    assert abs(r.mean[1] - 3) < 3 * r.sd[1] and abs(r.mean[2]) < 3 * r.sd[2]


def test_filters(rows):
    fits = rows("k11_fit").set_index(["src", "dst"])
    for (src, dst), g in rows("k19_filters").groupby(["src", "dst"]):
        h = g.sort_values("pos").h.to_numpy()
        assert fits.converged[src, dst] and np.allclose(h[:12], fits.beta[src, dst][2]) and not h[12:].any() and not g.se[g.pos >= 12].any()
    assert len(rows("k19_filters")) == 24 * fits.converged.sum()


def test_widths(spark, driven, rows):
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long")
    every = design.width_designs(driven, pairs, TRIALS, LENGTH, LAG, [300_000, 900_000], 1e6, self_coupling=True).toPandas()
    for w in (300_000, 900_000):
        one = design.standard_design(driven, pairs, TRIALS, LENGTH, LAG, w, 1e6, self_coupling=True).toPandas().sort_values(["src", "trial_id", "y_us"])
        same = every[every.width == w].sort_values(["src", "trial_id", "y_us"])
        assert all(np.allclose(same[c], one[c]) for c in (*COLUMNS, "own", "w"))
    for name in ("k23_width_by_refit", "k23_width_by_self_refit"):
        assert len(rows(name)) == 375 and rows(name).width.isin([1, 2, 4, 8]).all()


def test_memberships_find_planted_heights(spark, driven):
    """x drives y by 4 a second for 50 ms in pair (1, 2), and not at all in (3, 2)."""
    pairs = spark.createDataFrame([(1, 2), (3, 2), (1, 9)], "src long, dst long")
    d = design.standard_design(driven, pairs, TRIALS, LENGTH, LAG, 500_000, 1e6)
    heights = {0: 0.0, 1: 4.0, 2: -2.0}
    scores, by_sums = (fit.membership_nlls(d, heights, dict.fromkeys(heights, 1 / 3), [TRIALS * LENGTH / 1e6, 0.0], most) for most in (10**7, 1000))
    a, b = (x.toPandas().set_index(["src", "dst", "group_id"]).score.sort_index() for x in (scores, by_sums))
    assert len(a) == 6 and np.allclose(a, b, rtol=1e-12)
    for sample in (False, True):
        got = {(r.src, r.dst): r.group_id for r in fit.update_membership(pairs, scores, sample=sample).collect()}
        assert got == {(1, 2): 1, (3, 2): 0, (1, 9): None}


def test_membership_queries(rows):
    plain, drawn, driven = (rows(q).set_index(["src", "dst"]).group_id for q in ("k25_update_membership", "k25_sample_membership", "k26_update_with_drivers"))
    assert plain.dropna().isin(range(5)).all() and drawn.dropna().isin(range(5)).all() and driven.notna().all()
    end = rows("w3_membership_rounds")
    assert end.portion.between(0, 1).all() and end.portion.sum() <= 1 + 1e-9


def test_network(rows):
    got = rows("w1_network")
    assert (got.src_probe != got.dst_probe).all() and not got.duplicated(["src", "dst"]).any()
    some = got.dropna(subset=["pval" if "pval" in got else "p"])
    p = some["pval" if "pval" in got else "p"]
    assert (some.bh >= p - 1e-12).all() and (some.significant == (some.bh < 0.05)).all()


def planted(spark, rng):
    centre = np.array([[0, 0, 9.0], [9, 0, 0], [0, 9, 0]])
    made = [(i, i + 100, (centre[i % 3] + 0.1 * rng.standard_normal(3)).tolist()) for i in range(60)]
    return spark.createDataFrame(made, "src long, dst long, y array<double>")


def test_clusters_are_the_planted_ones(spark, rows):
    got = graph.cluster(planted(spark, np.random.default_rng(1)), "y", 3).collect()
    groups = [{r.cluster for r in got if r.src % 3 == g} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    means = graph.cluster_means(graph.cluster(planted(spark, np.random.default_rng(1)), "y", 3), "y").collect()
    assert sum(r.mean_value > 8.5 for r in means) == 3 and {r.n for r in means} == {20}
    turned = spark.createDataFrame([(1, 2, [5.0, 1.0, 0.0, 0.0, 0.0]), (3, 4, [0.0, 0.0, 0.0, 1.0, 5.0])], "src long, dst long, y array<double>")
    assert {tuple(r.y) for r in graph.unify_direction(turned).collect()} == {(0.0, 0.0, 0.0, 1.0, 5.0)}
    assert rows("l7_filter_clusters").pos.nunique() == 3 and rows("l6_clusters").n.sum() > 0


def test_spectra(spark, rows):
    n, fs = 256, 16.0
    wave = [("a", k, 3 * math.sin(2 * math.pi * 2.0 * k / fs) + 5) for k in range(n)]
    s = spark.createDataFrame(wave, "key string, bin long, y double")
    got = series.welch(s, ("key",), n, fs, 64).toPandas().sort_values("k")
    assert got.frequency[got.power.idxmax()] == 2.0
    assert got.power.sum() * fs / 64 == pytest.approx(4.5, rel=0.05)  # the variance of the wave
    short = series.spectrogram(s, ("key",), n, fs, 64, 32, 64, tukey=1.0).toPandas()
    assert set(short.groupby("segment").apply(lambda g: g.frequency[g.power.idxmax()], include_groups=False)) == {2.0} and short.segment.nunique() == 7
    assert (rows("n4_welch").power >= 0).all() and (rows("n5_spectrogram").power >= 0).all()


def test_jitter_p_of_a_certain_case(spark):
    """y stands on x: no surrogate does as well, and p is the least there is."""
    rng = np.random.default_rng(2)
    x = [(1, k, int(t)) for k in range(20) for t in rng.integers(0, 10_000, 5)]
    p = spark.createDataFrame(x + [(2, k, t) for _, k, t in x], "unit_id long, trial_id long, t_us long")
    pairs = spark.createDataFrame([(1, 2)], "src long, dst long")
    for basic in (False, True):
        r = synchrony.jitter_p(p, pairs, 5, 1000, 99, basic).first()
        assert r.p == r.p_rnd == 0.01 and r.s >= 100


def test_area_classes(spark):
    from tidewell.operators import select

    areas = ["VISp", "CA1", "LGd", "APN", "root", None]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in areas], "area string").select(select.area_class(F.col("area"))).collect()]
    assert got == ["visual", "hippocampus", "thalamus", "midbrain", "other", "other"]
