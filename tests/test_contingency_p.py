"""Hubs, broadcasts, mean tables and marks by the chi-square tail, against brute force on a small fixture."""

import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from tidewell.plans import inference

ALPHA = 0.3


def brute_test(table):
    """(p, Cramer's V) of a Counter of (cat0, cat1), with Yates' correction at one degree of freedom."""
    rows, cols = sorted({i for i, _ in table}), sorted({j for _, j in table})
    o = np.array([[table[i, j] for j in cols] for i in rows], float)
    e, dof = np.outer(o.sum(axis=1), o.sum(axis=0)) / o.sum(), (len(rows) - 1) * (len(cols) - 1)
    gap = np.abs(o - e)
    chi2 = ((gap - np.minimum(0.5, gap) * (dof == 1)) ** 2 / e).sum() if dof else 0.0
    if dof == 0:
        p = 1.0
    elif dof == 1:
        p = math.erfc(math.sqrt(chi2 / 2))
    else:
        assert dof % 2 == 0
        p = math.exp(-chi2 / 2) * sum((chi2 / 2) ** k / math.factorial(k) for k in range(dof // 2))
    return p, math.sqrt(chi2 / o.sum() / 5)


@pytest.fixture(scope="module")
def known(spark):
    """Pathways 1..3 -> 11, 12 and 11, 12 -> 21, 22; those into and out of 11 are coupled, the others not."""
    rng, cells = np.random.default_rng(8), {}
    for s0 in (1, 2, 3):
        for d0 in (11, 12):
            for s1 in (11, 12):
                for d1 in (21, 22):
                    k = 2 if s0 == 3 else 3
                    c0 = np.arange(60) % k
                    c1 = np.where(rng.random(60) < 0.8, c0, rng.integers(0, k, 60)) if d0 == s1 == 11 else rng.permutation(c0)
                    cells[s0, d0, s1, d1] = Counter(zip(c0.tolist(), c1.tolist(), strict=True))
    rows = [(*pair, i, j, n) for pair, table in cells.items() for (i, j), n in table.items()]
    pairs = [(s, d) for s in (1, 2, 3) for d in (11, 12)] + [(s, d) for s in (11, 12) for d in (21, 22)] + [(7, 8)]
    t = SimpleNamespace(
        cells=spark.createDataFrame(rows, "src0 long, dst0 long, src1 long, dst1 long, cat0 int, cat1 int, n long"), pairs=spark.createDataFrame(pairs, "src long, dst long")
    )
    return t, cells, {pair: brute_test(table) for pair, table in cells.items()}, pairs


def test_hubs_and_broadcasts(known):
    t, _, tests, _ = known
    hit = [pair for pair, (p, _) in tests.items() if p < ALPHA]
    assert {(s, 11, 11, d) for s in (1, 2, 3) for d in (21, 22)} <= set(hit)
    meet = defaultdict(list)
    for s0, d0, s1, d1 in hit:
        if d0 == s1:
            meet[d0].append((s0, d1))
    hubs = {m: v for m, v in meet.items() if len(v) > 0.06 * 25}
    assert {(r.mid, r.n, r.n_src) for r in inference.h6_p(t).collect()} == {(m, len(v), len({s for s, _ in v})) for m, v in hubs.items()}
    members = {(r.mid, r.src0, r.dst1): r.p for r in inference.h6m_p(t).collect()}
    assert members == {(m, s, d): pytest.approx(tests[s, m, m, d][0], abs=1e-9) for m, v in hubs.items() for s, d in v}
    ends = defaultdict(list)
    for s0, d0, s1, d1 in hit:
        ends[s0, d1].append(d0 == s1)
    assert {(r.source, r.target, r.n, r.n_hub) for r in inference.h6b_p(t).collect()} == {(*k, len(v), sum(v)) for k, v in ends.items() if len(v) > 0.051 * 25}


def test_mean_tables_and_marks(known):
    t, cells, tests, pairs = known
    hit = [pair for pair, (p, _) in tests.items() if p < ALPHA]
    every, some = sum(cells.values(), Counter()), sum((cells[p] for p in hit), Counter())
    got = {(r.cat0, r.cat1): (r.mean_n, r.mean_n_significant) for r in inference.h7_p(t).collect()}
    assert got == {c: (pytest.approx(every[c] / len(tests)), pytest.approx(some[c] / len(hit))) for c in every}
    v = inference.h7b_p(t).first()
    assert v.mean_v == pytest.approx(np.mean([x for _, x in tests.values()])) and v.mean_v_significant == pytest.approx(np.mean([tests[p][1] for p in hit]))
    degree = Counter(e for s0, d0, s1, d1 in hit for e in ((s0, d0), (s1, d1)))
    assert {(r.src, r.dst): (r.marked, r.degree) for r in inference.h8_p(t).collect()} == {p: (int(degree[p] > 0), degree[p]) for p in pairs}


def test_tails_like_the_error_function(spark):
    from tidewell.functions.columns import chi2_tail, norm_tail
    from tidewell.functions.numeric import chi2_sf
    from pyspark.sql import functions as F

    z = [0.0, 0.3, 1.0, 2.5, 5.0, 7.0, 7.2, 12.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(norm_tail(F.col("z"))).collect()]
    assert all(g == pytest.approx(0.5 * math.erfc(v / math.sqrt(2)), rel=1e-11) for g, v in zip(got, z, strict=True))
    cases = [(x, d) for d in range(0, 20) for x in (0.0, 1e-9, 0.4, 3.0, 17.0, 60.0, 400.0)]
    got = [r[0] for r in spark.createDataFrame(cases, "x double, d int").select(chi2_tail(F.col("x"), F.col("d"))).collect()]
    assert all(g == pytest.approx(chi2_sf(x, d), rel=1e-9, abs=1e-300) for g, (x, d) in zip(got, cases, strict=True))


@pytest.mark.parametrize("block_pairs", [2, 1000])
def test_shared_cells_of_any_block_size(spark, block_pairs):
    from tidewell.operators.pairs import shared_cells

    rng = np.random.default_rng(3)
    trials = [*range(-3, 200), 5000, 62 * 16 * 9 + 1]
    p0, p1 = [(s, 10) for s in range(7)], [(10, d) for d in range(20, 25)]
    rows = [(s, d, k, int(g) if g < 3 else None) for s, d in p0 + p1 for k, g in zip(trials, rng.integers(0, 4, len(trials)), strict=True)]
    member = spark.createDataFrame(rows, "src long, dst long, trial_id long, group_id int")
    path = lambda p: spark.createDataFrame(p, "src long, dst long")
    got = {tuple(r)[:6]: r.n for r in shared_cells(member, path(p0), path(p1), block_pairs).collect()}
    group = {(s, d, k): g for s, d, k, g in rows if g is not None}
    want = Counter((*a, *b, group[*a, k], group[*b, k]) for a in p0 for b in p1 for k in trials if (*a, k) in group and (*b, k) in group)
    assert got == want
