"""Sums of a kernel over one train's events, at the events of another: in one pass, not over all pairs of events.

``x``: sorted times in whole microseconds, ``c``: how many events at each, ``y``: times in any order. A delay is d = y - x.
Counts and straight kernels are differences of running sums, exponentials are running sums that decay, and a Gaussian
is a local power series of what lies around: work grows with the events, not with their product.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tidewell.functions.numeric import bspline

#: Terms of the power series of the Gaussian; a quarter of a width from a centre the rest is below 1e-14.
TERMS = 15
#: Slots of half a width: up to this many apart, all delays lie within 5 widths; one further, some do.
INSIDE = 9
#: Trains shorter than this meet event by event, which is then less work.
FEW = 256


def running(c: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(c)])


def between(x: np.ndarray, y: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each y the run of x with low < d <= high, as first and last + 1."""
    return np.searchsorted(x, y - high, "left"), np.searchsorted(x, y - low, "left")


def count(x: np.ndarray, c: np.ndarray, y: np.ndarray, low: int, high: int, scale: float = 1.0) -> np.ndarray:
    """scale x the number of events with low < d <= high."""
    n, (first, last) = running(c), between(x, y, low, high)
    return scale * (n[last] - n[first])


def delay(x: np.ndarray, c: np.ndarray, y: np.ndarray, low: int, high: int) -> np.ndarray:
    """The sum of d over the events with low < d <= high, in whole numbers."""
    n, s, (first, last) = running(c), running(c * x), between(x, y, low, high)
    return (n[last] - n[first]) * y - (s[last] - s[first])


def window_count(x: np.ndarray, c: np.ndarray, y: np.ndarray, width: int, scale: float) -> np.ndarray:
    """scale x the number of events in y's own window [k width, (k + 1) width)."""
    n, start = running(c), y // width * width
    return scale * (n[np.searchsorted(x, start + width, "left")] - n[np.searchsorted(x, start, "left")])


def triangle(x: np.ndarray, c: np.ndarray, y: np.ndarray, half: int, scale: float) -> np.ndarray:
    """scale x the sum of half - abs(d) over -half < d <= half, in whole numbers until the end."""
    n, s = running(c), running(c * x)
    a0, a1 = between(x, y, 0, half)
    b0, b1 = between(x, y, -half, 0)
    early = (n[a1] - n[a0]) * (half - y) + s[a1] - s[a0]
    late = (n[b1] - n[b0]) * (half + y) - (s[b1] - s[b0])
    return scale * (early + late)


def ramp(x: np.ndarray, c: np.ndarray, y: np.ndarray, low: int, high: int, rising: bool) -> np.ndarray:
    """The sum over low < d <= high of what rises from 0 at ``low`` to 1 at ``high``, or falls from 1 to 0; in whole numbers until the end."""
    n, s, (first, last) = running(c), running(c * x), between(x, y, low, high)
    m = n[last] - n[first]
    d = m * y - (s[last] - s[first])
    return (d - m * low if rising else m * high - d) / (high - low)


def splines(x: np.ndarray, c: np.ndarray, y: np.ndarray, length: int, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many events have 0 < d <= length, the sums of every cubic B-spline of d / length over them), for sorted y.

    Between two knots the bases are cubics, so sums are those of the powers of x, from running sums around the stretch of
    ``length`` in which y lies.
    """
    edges = np.rint(inner * length).astype(np.int64)  # the bases join smoothly, so either side of a knot will do
    at = np.array([0.1, 0.4, 0.6, 0.9])
    cubics = [np.linalg.solve(np.vander(at, increasing=True), bspline(inner, (a + at * (b - a)) / length)) for a, b in zip(edges, edges[1:])]
    out, n, stretch = np.zeros((len(y), cubics[0].shape[1])), count(x, c, y, 0, length, 1), y // length
    for k in np.unique(stretch[n > 0]).tolist():
        lo, hi = np.searchsorted(stretch, [k, k + 1])
        near = slice(np.searchsorted(x, (k - 1) * length, "left"), np.searchsorted(x, (k + 1) * length, "left"))
        here, q = y[lo:hi], (x[near] - k * length) / length
        sums = [running(c[near] * q**m) for m in range(4)]
        for cubic, a, b in zip(cubics, edges, edges[1:]):
            first, last = between(x[near], here, a, b)
            m0, m1, m2, m3 = (s[last] - s[first] for s in sums)
            v, w = (here - k * length - a) / length, (b - a) / length
            powers = [m0, (v * m0 - m1) / w, (v * v * m0 - 2 * v * m1 + m2) / w**2, (v**3 * m0 - 3 * v * v * m1 + 3 * v * m2 - m3) / w**3]
            out[lo:hi] += np.stack(powers, axis=1) @ cubic
    return n, out


def log_running(log_terms: np.ndarray) -> np.ndarray:
    """Logarithms of running sums, from those of the terms; the first is that of nothing."""
    return np.concatenate([[-np.inf], np.logaddexp.accumulate(log_terms)]) if len(log_terms) else np.full(1, -np.inf)


def exponential(x: np.ndarray, c: np.ndarray, y: np.ndarray, rate: float, unit: float) -> np.ndarray:
    """The sum of exp(-rate d / unit) over all d > 0."""
    upto = log_running(rate * (x / unit) + np.log(c))
    return np.exp(upto[np.searchsorted(x, y, "left")] - rate * (y / unit))


def exponential_slope(x: np.ndarray, c: np.ndarray, y: np.ndarray, rate: float, unit: float) -> np.ndarray:
    """Its derivative by the rate: the sum of -(d / unit) exp(-rate d / unit)."""
    t = (x - x[0]) / unit if len(x) else np.zeros(0)
    upto, i = log_running(rate * t + np.log(c)), np.searchsorted(x, y, "left")
    with np.errstate(divide="ignore"):
        moved = log_running(rate * t + np.log(c) + np.log(t))
    at = (y - x[0]) / unit if len(x) else np.zeros(len(y))
    return np.exp(moved[i] - rate * at) - at * np.exp(upto[i] - rate * at)


def laplacian(x: np.ndarray, c: np.ndarray, y: np.ndarray, reach: int, scale: float) -> np.ndarray:
    """The sum of exp(-abs(d) / scale) / (2 scale) over -reach < d <= reach; ``scale`` in microseconds, per microsecond."""
    log_c, at = np.log(c), y / scale
    early = log_running(x / scale + log_c)
    first, now = between(x, y, 0, reach)
    out = np.exp(early[now] - at) - np.exp(early[first] - at)
    late = log_running((log_c - x / scale)[::-1])
    last = np.searchsorted(x, y + reach, "left")
    return (out + np.exp(late[len(x) - now] + at) - np.exp(late[len(x) - last] + at)) / (2 * scale)


def _hermite(z: np.ndarray, terms: int) -> list[np.ndarray]:
    """He_q(z) phi(z) for q = 0, 1, ...: (-1)^q times the q-th derivative of the Normal density."""
    out = [np.exp(-z * z / 2) / math.sqrt(2 * math.pi)]
    out.append(z * out[0])
    for q in range(1, terms - 1):
        out.append(z * out[q] - q * out[q - 1])
    return out[:terms]


def _gaussian_pairs(x: np.ndarray, c: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(y))
    for lo in range(0, len(y), 2048):
        d = y[lo : lo + 2048, None] - x[None, :]
        inside = (d > -5 * width) & (d <= 5 * width)
        out[lo : lo + 2048] = np.where(inside, np.exp(-((d / width) ** 2) / 2), 0.0) @ c
    return out / math.sqrt(2 * math.pi)


def gaussian(x: np.ndarray, c: np.ndarray, y: np.ndarray, width: int, scale: float = 1.0) -> np.ndarray:
    """scale x the sum of the Normal density at d / width over -5 width < d <= 5 width.

    Events are summed up by slots of half a width as moments around the slot's centre. Each slot turns the moments of
    the 19 slots around it into one power series for the y events in it. Of the two slots in which 5 widths end, running
    moments give the part that counts.
    """
    if len(x) <= FEW:
        return scale * _gaussian_pairs(x, c, y, width)
    slot = lambda t: np.floor(2 * t / width).astype(np.int64)
    kx, ky = slot(x), slot(y)
    base, size = min(kx[0], ky.min()) - INSIDE - 1, max(kx[-1], ky.max()) - min(kx[0], ky.min()) + 2 * INSIDE + 3
    kx, ky = kx - base, ky - base
    centre = lambda k: (k + base + 0.5) / 2
    u = x / width - centre(kx)
    powers = np.ones((TERMS, len(x))) * c
    for m in range(1, TERMS):
        powers[m] = powers[m - 1] * u / m
    moments = np.stack([np.bincount(kx, p, size) for p in powers], axis=1)
    derivative = np.stack(_hermite(np.arange(-INSIDE, INSIDE + 1) / 2, 2 * TERMS - 1), axis=1)
    m, n = np.indices((TERMS, TERMS))
    series = np.zeros((size, TERMS))
    for o in range(-INSIDE, INSIDE + 1):  # how many slots y's slot is after x's
        moved = np.roll(moments, o, axis=0)  # the outermost slots are empty
        series += moved @ (derivative[o + INSIDE][m + n] * (-1.0) ** n)
    v = y / width - centre(ky)
    out = np.zeros(len(y))
    for n in range(TERMS - 1, -1, -1):
        out = out * v / (n + 1) + series[ky, n]
    sums = np.concatenate([np.zeros((TERMS, 1)), np.cumsum(powers, axis=1)], axis=1)
    starts = np.searchsorted(kx, np.arange(size + 1), "left")
    for o in (INSIDE + 1, -INSIDE - 1):
        k = ky - o
        lo, hi = starts[np.clip(k, 0, size)], starts[np.clip(k + 1, 0, size)]
        if o > 0:
            lo = np.clip(np.searchsorted(x, y - 5 * width, "left"), lo, hi)
        else:
            hi = np.clip(np.searchsorted(x, y + 5 * width, "left"), lo, hi)
        for m, h in enumerate(_hermite(y / width - centre(k), TERMS)):
            out += (sums[m][hi] - sums[m][lo]) * h
    return scale * out


#: Of Targets: parts of a width that are a slot, slots up to which all delays lie within 5 widths, terms of the power series
#: (the rest is below 1e-15), terms of that of exp(uv) at the ends (1e-11 of a density of 3e-6), slots and y events
#: worked on at once.
FINE, WITHIN, SERIES, ENDS, SLOTS, POWERS = 8, 39, 10, 4, 256, 4096
#: Of Steps: events looked up at once.
LOOKED = 8192
#: Pairs of events up to which trains meet event by event, as that is less work than the slots.
BRIEF = 4_000


class Targets:
    """One sorted train of targets that many trains of x meet, such as surrogates: kernel sums at every y, in order.

    What hangs on y alone is made once. An x event is looked up among the targets, not each target among x, so that the many
    targets of one source cost a few running sums each. ``x`` (line x event): sorted times of several trains, ``c``: how many
    events at each; results are line x y.
    """

    def __init__(self, y: np.ndarray, width: int) -> None:
        self.y, self.width = y, width
        k = FINE * y // width
        self.base = int(k[0]) if len(y) else 0
        self.size = int(k[-1]) - self.base + 1 if len(y) else 0
        self.starts = np.searchsorted(k, self.base + np.arange(self.size + 1), "left")
        self.v = v = self._within(y, k)
        self.ends = [np.exp(s * 5 * v - v * v / 2 - 12.5) / math.sqrt(2 * math.pi) for s in (-1, 1)]

    def _within(self, t: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How far times are from the centres of their slots, in widths."""
        return (FINE * t - k * self.width) / (FINE * self.width) - 0.5 / FINE

    def count(self, x: np.ndarray, c: np.ndarray, length: int) -> np.ndarray:
        """The number of events with 0 < d <= length."""
        n, lines = len(self.y) + 1, len(x)
        line = (np.arange(lines) * n)[:, None]
        c = np.broadcast_to(c, x.shape).ravel()
        first, end = (np.searchsorted(self.y, t, "right") + line for t in (x, x + length))
        return _runs(first.ravel(), end.ravel(), c, lines, n)

    def gaussian(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The sum of the Normal density at d / width over -5 width < d <= 5 width."""
        n, c = len(self.y), np.broadcast_to(c, x.shape)
        if x.shape[1] * n <= BRIEF:
            return np.stack([_gaussian_pairs(line, own, self.y, self.width) for line, own in zip(x, c, strict=True)])
        line, x, c = np.repeat(np.arange(len(x)), x.shape[1]), x.ravel(), c.ravel()
        lines, k = int(line[-1]) + 1, FINE * x // self.width
        u, out = self._within(x, k), np.empty((lines, n))
        series, starts = self._series(line, lines, k, u, c), self.starts.tolist()
        some = max(1, POWERS * self.size // n)
        for a in range(0, self.size, some):  # powers of some y events at a time
            first, end = starts[a], starts[min(a + some, self.size)]
            v = np.ones((SERIES, end - first))
            for m in range(1, SERIES):
                np.multiply(v[m - 1], self.v[first:end], out=v[m])
            for i in range(a, min(a + some, self.size)):
                if starts[i] < starts[i + 1]:
                    np.matmul(series[:, i], v[:, starts[i] - first : starts[i + 1] - first], out=out[:, starts[i] : starts[i + 1]])
        for side, tail in zip((1, -1), self.ends, strict=True):  # y after x, y before x
            self._end(side, tail, line, lines, x, c, k, u, out)
        return out

    def _series(self, line: np.ndarray, lines: int, k: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(line x slot of y x term): the power series around each slot's centre of what lies up to WITHIN slots away."""
        at, span = k - self.base + WITHIN, self.size + 2 * WITHIN
        near = (at >= 0) & (at < span)
        at, u, power = (line * span + at)[near], u[near], c[near].astype(float)
        moments = np.empty((lines * span, SERIES))
        for m in range(SERIES):
            moments[:, m] = np.bincount(at, power, lines * span)
            power *= u / (m + 1)
        series = np.empty((lines, self.size, SERIES))
        for own, to in zip(moments.reshape(lines, -1), series, strict=True):
            windows = np.lib.stride_tricks.sliding_window_view(own, (2 * WITHIN + 1) * SERIES)[::SERIES]
            for i in range(0, self.size, SLOTS):
                np.matmul(np.ascontiguousarray(windows[i : i + SLOTS]), _moved(), out=to[i : i + SLOTS])
        return series

    def _end(self, side: int, tail: np.ndarray, line: np.ndarray, lines: int, x: np.ndarray, c: np.ndarray, k: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
        """Adds what the slots give in which 5 widths end: x events count for a run of the y events there."""
        q = k - self.base + side * (WITHIN + 1)
        near = np.flatnonzero((q >= 0) & (q < self.size))
        if not len(near):
            return
        q, u, line = q[near], u[near], line[near]
        lo, hi = self.starts[q], self.starts[q + 1]
        last = np.clip(np.searchsorted(self.y, x[near] + side * 5 * self.width, "right"), lo, hi)
        first, end = (lo, last) if side > 0 else (last, hi)
        at = slice(int(first.min()), int(end.max()))
        n = at.stop - at.start + 1
        if n < 2:
            return
        first, end = (line * n + t - at.start for t in (first, end))
        weight, terms, v = c[near] * np.exp(side * 5 * u - u * u / 2), [], self.v[at]
        for _ in range(ENDS):
            terms.append(_runs(first, end, weight, lines, n))
            weight = weight * u
        total = terms[-1]
        for m in range(ENDS - 1, 0, -1):
            total *= v / m
            total += terms[m - 1]
        total *= tail[at]
        out[:, at] += total


class Steps:
    """How many events of each of several trains ``ys`` are at most ``delta`` from a time: steps at which a count changes, in
    order, and a row of counts after each."""

    def __init__(self, ys: list[np.ndarray], cys: list[np.ndarray], delta: int) -> None:
        edges = np.concatenate([*[y - delta for y in ys], *[y + delta + 1 for y in ys]])
        steps, whose = np.concatenate([*cys, *[-c for c in cys]]), np.tile(np.repeat(np.arange(len(ys)), [len(y) for y in ys]), 2)
        order = np.argsort(edges, kind="stable")
        self.edges, self.after = edges[order], np.zeros((len(edges) + 1, len(ys)))
        self.after[1 + np.arange(len(edges)), whose[order]] = steps[order]
        np.cumsum(self.after, axis=0, out=self.after)

    def near(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(line x train): their sums over the events of each line of x, whose times are sorted, ``c`` at each. Whole numbers."""
        c, out = np.broadcast_to(np.asarray(c, float), x.shape), np.empty((len(x), self.after.shape[1]))
        some = max(1, LOOKED // max(1, x.shape[1]))
        for i in range(0, len(x), some):
            at, n = x[i : i + some], c[i : i + some]
            total = 0.0
            for j in range(0, x.shape[1], LOOKED):
                rows = self.after[np.searchsorted(self.edges, at[:, j : j + LOOKED], "right")]
                total = total + np.matmul(n[:, None, j : j + LOOKED], rows)[:, 0]
            out[i : i + some] = total
        return out


def _runs(first: np.ndarray, end: np.ndarray, weight: np.ndarray, lines: int, n: int) -> np.ndarray:
    """(line x place): the weights whose run from ``first`` up to before ``end`` holds a place, of ``n`` - 1 places in each line."""
    steps = np.bincount(first, weight, lines * n)
    steps -= np.bincount(end, weight, lines * n)
    steps = steps.reshape(lines, n)
    return np.cumsum(steps, axis=1, out=steps)[:, :-1]


@lru_cache(1)
def _moved() -> np.ndarray:
    """(slot before y's and term x term): what moments of x around give to the series of y's slot."""
    z = np.arange(WITHIN, -WITHIN - 1, -1) / FINE
    m, n = np.indices((SERIES, SERIES))
    share = np.array([(-1.0) ** i / math.factorial(i) for i in range(SERIES)])
    return np.concatenate([d[m + n] * share for d in np.stack(_hermite(z, 2 * SERIES - 1), axis=1)])


def binned(b: np.ndarray, n: np.ndarray, n_bins: int, low: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, reached) of every bin: sums of n x weights[o - low] over events o = low, low + 1, ... bins before, and
    whether there are any.

    Equal weights are differences of running sums; others one convolution, by Fourier transform where that is less work.
    """
    dense = np.zeros(n_bins)
    np.add.at(dense, b, n)
    span = len(weights)
    first = np.clip(np.arange(n_bins) - low - span + 1, 0, n_bins)
    last = np.clip(np.arange(n_bins) - low + 1, 0, n_bins)
    around = lambda v: (lambda s: s[last] - s[first])(running(v))
    reached = around(dense > 0) > 0
    if np.ptp(weights) == 0:
        return weights[0] * around(dense), reached
    if n_bins * span > 4_000_000:
        size = 1 << (n_bins + span - 2).bit_length()
        whole = np.fft.irfft(np.fft.rfft(dense, size) * np.fft.rfft(weights, size), size)[: n_bins + span - 1]
    else:
        whole = np.convolve(dense, weights)
    at = np.arange(n_bins) - low
    inside = (at >= 0) & (at < len(whole))
    return np.where(inside & reached, whole[np.clip(at, 0, len(whole) - 1)], 0.0), reached
