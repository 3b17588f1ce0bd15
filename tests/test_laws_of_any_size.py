"""Poisson, Binomial and Normal laws of large means: work grows with their spread, and no mass is lost."""

import math
import time

import numpy as np

from tidewell.functions import numeric


def test_masses_are_those_of_the_formulas():
    for mu in (0.01, 3.0, 700.0, 40_000.0):
        low, p = numeric.poisson_masses(mu)
        for k in (0, 1, int(mu), int(mu + 3 * math.sqrt(mu)) + 1):
            want = math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
            assert abs((p[k - low] if k >= low else 0.0) - want) <= 1e-9 * want + 1e-300
    for n, q in ((7, 0.3), (5000, 0.02), (100_000, 0.4)):
        low, p = numeric.binom_masses(n, q)
        for k in (0, int(n * q), min(n, int(n * q) + 5), n):
            want = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q))
            assert abs((p[k - low] if low <= k < low + len(p) else 0.0) - want) <= 1e-8 * want + 1e-300


def test_large_means_take_no_time():
    began = time.time()
    for mu in (1e6, 1e8):
        assert 0.49 < numeric.poisson_cdf(int(mu), mu) < 0.51 and abs(numeric.poisson_ppf(0.5, mu) - mu) < 2
    assert abs(numeric.binom_sf(40_000_000, 100_000_000, 0.4) - 0.5) < 1e-3
    assert time.time() - began < 5


def test_more_events_than_bins_in_a_window():
    start, p = numeric.joint_binom_masses([(60, 1000, 30), (24, 2, 1)], 48)
    assert start == 30_000 and np.allclose(p, [0.25, 0.5, 0.25])
    assert numeric.normal_law(100.2, -5.0, 400)[0] == 100
    start, p = numeric.poisson_law(60 * 60 / 48 * 100, 12_000)
    assert abs(start + np.arange(len(p)) @ p - 7500) < 1e-6
    assert numeric.pmf_summary(np.array([0.25, 0.5, 0.25]), 12, 0.05, 0.5, 11) == (11, 13, 12.0, 0.75, 0.5)
