"""Small NumPy helpers for what columns can't say: tails, exact mass functions, bases, solves.

Each works on the numbers of one row or one key and is called inside a pandas function.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

from tidewell.functions.columns import NORMAL, NORMAL_T


def uniform_of(*parts: int) -> float:
    """functions.columns.uniform of whole numbers."""
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:8], 16) / float(1 << 32)


#: Of MD5: turns of each step, and constants; the order in which the words of a block are taken.
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TAKEN = [i % 16 for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
#: Messages that are hashed at once, so that all that is at work stays near the processor.
HASHED = 8192


def md5_first(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first four bytes of the MD5 digests of ``n`` messages of one block, as big-endian numbers. ``words``: the 16 words of
    the blocks, each an array, or a number where all messages agree."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps make the other words
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        word, turn = words[TAKEN[i]], TURNS[kind][i % 4]
        if isinstance(word, int):
            f += np.uint32((SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(SINES[i])
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(0x67452301)
    return b.byteswap()


class Uniforms:
    """functions.columns.uniform of many heads, each to be joined by '/' to any tail. Heads become words of MD5 blocks once; a
    tail is then set into them, at the place where each head ends."""

    def __init__(self, heads: list[str]) -> None:
        raw = [f"{h}/".encode() for h in heads]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.n, self.order = len(raw), np.argsort(sizes, kind="stable")
        lengths, starts = np.unique(sizes[self.order], return_index=True)
        self.alike = [(int(size), slice(a, b)) for size, a, b in zip(lengths, starts.tolist(), np.append(starts, self.n)[1:].tolist(), strict=True)]
        chars = np.zeros((self.n, -(-int(sizes.max(initial=0)) // 4) * 4), np.uint8)
        for size, at in self.alike:
            chars[at, :size] = np.frombuffer(b"".join([raw[i] for i in self.order[at].tolist()]), np.uint8).reshape(-1, size)
        self.head = np.ascontiguousarray(chars.view("<u4").T)

    def __call__(self, tails: list[str]) -> np.ndarray:
        """(tail x head)."""
        out, many = np.empty((len(tails), self.n)), max(1, HASHED // max(1, self.n))
        for i in range(0, len(tails) if self.n else 0, many):
            some = [t.encode() for t in tails[i : i + many]]
            small = len(some) * self.n < HASHED // 16 or self.alike[-1][0] + max(map(len, some)) > 55  # or more than a block
            out[i : i + many, self.order] = self._each(some) if small else self._together(some)
        return out / float(1 << 32)

    def _each(self, tails: list[bytes]) -> np.ndarray:
        rows = np.ascontiguousarray(self.head.T).view(np.uint8)
        heads = [row.tobytes() for size, at in self.alike for row in rows[at, :size]]
        return np.frombuffer(b"".join([hashlib.md5(h + t).digest()[:4] for t in tails for h in heads]), ">u4").reshape(len(tails), -1)

    def _together(self, tails: list[bytes]) -> np.ndarray:
        used = (self.alike[-1][0] + max(map(len, tails))) // 4 + 1
        words = np.zeros((used + 1, len(tails), self.n), np.uint32)  # the last: lengths in bits
        words[: len(self.head)] = self.head[:, None]
        for j, tail in enumerate(tails):
            for size, at in self.alike:
                rest = np.frombuffer((bytes(size) + tail + b"\x80").ljust(4 * used, b"\0"), "<u4")
                words[size // 4 : used, j, at] |= rest[size // 4 :, None]
                words[used, j, at] = 8 * (size + len(tail))
        words, out = words.reshape(used + 1, -1), []
        for i in range(0, words.shape[1], HASHED):
            few = words[:, i : i + HASHED]
            out.append(md5_first([*few[:used], *[0] * (14 - used), few[used], 0], few.shape[1]))
        return np.concatenate(out).reshape(len(tails), -1)


def uniforms_of(heads: list[str], tails: list[str]) -> np.ndarray:
    """functions.columns.uniform of every tail (row) after every head (column), each joined by '/'."""
    return Uniforms(heads)(tails)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """By bisection and Newton steps on the distribution itself."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if norm_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _reach(var: float) -> int:
    """Steps from the mean of a Poisson or Binomial law beyond which every mass is 0 in double precision, by Bernstein's bound."""
    return math.ceil(39 * math.sqrt(var)) + 500


def _masses(low: int, ratios: np.ndarray) -> tuple[int, np.ndarray]:
    """(low, masses at low, low + 1, ...) of a law from the ratio of each mass to the one before it; the rest are 0."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratios))])
    p = np.exp(logs - logs.max())
    return low, p / p.sum()


def poisson_masses(mu: float) -> tuple[int, np.ndarray]:
    """(first n, masses from there on): work grows with the root of mu."""
    if mu <= 0:
        return 0, np.ones(1)
    low, high = max(0, math.floor(mu) - _reach(mu)), math.ceil(mu) + _reach(mu)
    return _masses(low, mu / np.arange(low + 1, high + 1))


def binom_masses(n: int, p: float) -> tuple[int, np.ndarray]:
    """(first k, masses from there on) of Binom(n, p): work grows with the root of n."""
    if n == 0 or p <= 0:
        return 0, np.ones(1)
    if p >= 1:
        return n, np.ones(1)
    reach = _reach(n * p * (1 - p))
    low, high = max(0, math.floor(n * p) - reach), min(n, math.ceil(n * p) + reach)
    k = np.arange(low + 1, high + 1)
    return _masses(low, (n - k + 1) / k * (p / (1 - p)))


def above(low: int, masses: np.ndarray, n: float) -> float:
    """P(N > n)."""
    return min(1.0, float(masses[max(0, math.floor(n) + 1 - low) :].sum()))


def poisson_cdf(n: int, mu: float) -> float:
    low, p = poisson_masses(mu)
    return min(1.0, float(p[: max(0, math.floor(n) + 1 - low)].sum()))


def poisson_ppf(p: float, mu: float) -> int:
    """The smallest n with P(N <= n) >= p."""
    low, masses = poisson_masses(mu)
    return low + int(min(np.searchsorted(np.cumsum(masses), p), len(masses) - 1))


def binom_pmf(n: int, p: float) -> np.ndarray:
    low, masses = binom_masses(n, p)
    return np.concatenate([np.zeros(low), masses, np.zeros(n + 1 - low - len(masses))])


def binom_sf(s: int, n: int, p: float) -> float:
    """P(N >= s)."""
    return above(*binom_masses(n, min(1.0, p)), s - 1)


def power_pmf(pmf: np.ndarray, times: int) -> np.ndarray:
    """The mass function of a sum of ``times`` independent draws, by repeated squaring."""
    out, base = np.ones(1), np.asarray(pmf, float)
    while times:
        if times & 1:
            out = np.convolve(out, base)
        times >>= 1
        if times:
            base = np.convolve(base, base)
    return out


def joint_binom_masses(windows: list[tuple[int, int, int]], delta: int) -> tuple[int, np.ndarray]:
    """(first value, masses from there on) of sum Binom(n, m / delta) over windows (m, n, how many alike)."""
    start, out = 0, np.ones(1)
    for m, n, times in windows:
        low, p = binom_masses(n, min(1.0, m / delta))
        start += low * times
        out = np.convolve(out, power_pmf(p, times)) if len(p) > 1 else out
    return start, out


@lru_cache(100_000)
def occupancy_pmf(m: int, delta: int, n: int) -> tuple[float, ...]:
    """How many of m marked bins of delta are hit by n uniform throws: one throw after another hits a new marked bin or not."""
    m = min(m, delta)
    p = np.zeros(min(m, n) + 1)
    p[0] = 1
    k = np.arange(len(p))
    for _ in range(n):
        p = p * (delta - m + k) / delta + np.concatenate([[0], p[:-1] * (m - k[:-1]) / delta])
    return tuple(p.tolist())


def _law(p: np.ndarray) -> np.ndarray:
    """A mass function without its parts of less than 1e-12."""
    p = np.where(p > 1e-12, p, 0)
    return p / p.sum()


def _span(mean: float, var: float, most: int) -> np.ndarray:
    """The whole numbers below ``most`` (or below ten standard deviations above the mean, where that is more) at which a mass may
    be above 1e-12."""
    far = 10 * math.sqrt(var) + 60
    return np.arange(max(0, math.floor(mean - far)), max(1, min(max(most, math.ceil(mean + 10 * math.sqrt(var))), math.ceil(mean + far))))


def poisson_law(mean: float, most: int) -> tuple[int, np.ndarray]:
    """(first value, Poisson masses from there on), cut off at ``most``."""
    low, p = poisson_masses(mean)
    k = _span(mean, mean, most)
    return int(k[0]), _law(p[k[0] - low : k[-1] + 1 - low])


def normal_law(mean: float, var: float, most: int) -> tuple[int, np.ndarray]:
    """(first value, Normal densities from there on, for bins of width 1), cut off at ``most``; all at the mean if nothing varies.

    A window with more events than bins takes from ``var``, which then may be below 0: that is no variance either.
    """
    if var <= 0:
        return round(mean), np.ones(1)
    k, sd = _span(mean, var, most), math.sqrt(var)
    return int(k[0]), _law(np.exp(-(((k - mean) / sd) ** 2) / 2) / sd / math.sqrt(2 * math.pi))


def pmf_summary(pmf: np.ndarray, raw: float, alpha: float, u: float, start: int = 0) -> tuple[float, float, float, float, float]:
    """(lower, upper, mean, p, randomised p) of a mass function over start, start + 1, ..."""
    cdf = np.cumsum(pmf)
    low, high = (start + int(min(np.searchsorted(cdf, q - 1e-12), len(pmf) - 1)) for q in (alpha / 2, 1 - alpha / 2))
    mean = start + float(np.arange(len(pmf)) @ pmf)
    at = math.ceil(raw) - start
    if at < 0:
        return low, high, mean, float(pmf.sum()), float(pmf.sum())
    if at >= len(pmf):
        return low, high, mean, 0.0, 0.0
    return low, high, mean, float(pmf[at:].sum()), float(u * pmf[at] + pmf[at + 1 :].sum())


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-square with whole degrees of freedom, by its finite sums."""
    if dof <= 0 or x <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        return math.exp(-half) * sum(math.exp(k * math.log(half) - math.lgamma(k + 1)) for k in range(dof // 2))
    return math.erfc(math.sqrt(half)) + sum(math.exp(-half + (k + 0.5) * math.log(half) - math.lgamma(k + 1.5)) for k in range((dof - 1) // 2))


def t_sf2(t: float, dof: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / (max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1)))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or tiny)
                c = 1 + num / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def knots(n: int, length: float, offset: float = 0.1) -> np.ndarray:
    """``n`` knots on [0, length], closer together near 0: evenly spaced on a log scale shifted by ``offset`` x length."""
    shift = offset * length
    out = np.exp(np.linspace(math.log(shift), math.log(length + shift), n)) - shift
    out[0], out[-1] = 0.0, length
    return out


def bspline(inner: np.ndarray, x: np.ndarray, order: int = 4) -> np.ndarray:
    """The B-spline bases (columns) of an order on knots, whose ends count ``order`` times, by Cox and de Boor."""
    t = np.concatenate([[inner[0]] * (order - 1), inner, [inner[-1]] * (order - 1)])
    x = np.asarray(x, float)[:, None]
    last = np.flatnonzero(t[:-1] < t[1:])[-1]
    b = ((x >= t[:-1]) & (x < t[1:])).astype(float)
    b[:, last] += (x[:, 0] == t[-1]).astype(float)
    for k in range(1, order):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(left > 0, (x - t[: -k - 1]) / left, 0)
            down = np.where(right > 0, (t[k + 1 :] - x) / right, 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def newton(x: np.ndarray, weight: np.ndarray, integral: np.ndarray, offset: np.ndarray | None = None, start: np.ndarray | None = None,
           steps: int = 60, rate: float = 0.9, epsilon: float = 1e-5, ridge: np.ndarray | None = None, inside: bool = False) -> dict:
    """The coefficients with the least -sum w log(x b + offset) + b.integral, by damped Newton steps.

    Rows whose intensity is not positive are left out of a step and counted. A singular Hessian gets 0.01 on its
    diagonal; steps longer than 5 in all are scaled to 5. ``inside``: steps are halved until every intensity is positive
    and the value does not rise, from a start where all are positive; no row is left out then.
    """
    k = x.shape[1]
    b = np.full(k, 0.1) if start is None else start.astype(float).copy()
    offset = np.zeros(len(x)) if offset is None else offset
    ridge = np.zeros(k) if ridge is None else ridge

    def state(b: np.ndarray):
        lam = x @ b + offset
        ok = lam > 0
        w, z = weight[ok], x[ok] / lam[ok][:, None]
        nll = -(w * np.log(lam[ok])).sum() + b @ integral + 0.5 * (ridge * b * b).sum()
        return nll, -(w[:, None] * z).sum(axis=0) + integral + ridge * b, (z * w[:, None]).T @ z + np.diag(ridge), int((weight * ~ok).sum())

    done, n = False, 0
    nll, grad, hess, skipped = state(b)
    for n in range(1, steps + 1):
        try:
            step = np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError:
            step = np.linalg.solve(hess + 0.01 * np.eye(k), grad)
        size = np.abs(step).sum()
        step *= rate * (5 / size if size > 5 else 1)
        while inside and np.abs(step).sum() >= epsilon and ((x @ (b - step) + offset <= 0).any() or state(b - step)[0] > nll):
            step /= 2
        if inside and (x @ (b - step) + offset <= 0).any():
            break
        b = b - step
        nll, grad, hess, skipped = state(b)
        if np.abs(step).sum() < epsilon:
            done = not inside or size < 10 * epsilon  # a step that had to be halved to nothing is no end
            break
    return {"beta": b, "hessian": hess, "nll": float(nll), "n_iter": n, "converged": done, "skipped": skipped, "gradient": grad}


#: Multiples of a Newton step that a line search tries at once, beside 1 / (1 + decrement), which is always safe.
LENGTHS = [1024.0, 256.0, 64.0, 16.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.125, 2.0**-4, 2.0**-6, 2.0**-8, 2.0**-11]
ENDLESS, UNSETTLED = "the likelihood rises without end", "not settled"
#: Rows of a fit that are worked on at once: what a fit holds beside its design does not grow with it.
ROWS = 50_000
#: The same in newton_many, where they stay near the processor.
AT_WORK = 16_000


def newton_direction(grad: np.ndarray, hess: np.ndarray, n: float) -> tuple[np.ndarray | None, float]:
    """(step, decrement) of Newton's method for -sum w log(x b) + b.integral, over ``n`` events.

    The decrement is the step's length in standard errors, whatever the columns' scales. Directions in which no intensity
    changes are left alone; where the value falls along one of them it falls for ever, and there is no step.
    """
    size = np.sqrt(np.diag(hess))
    size = np.where(size > 0, size, 1.0)
    values, vectors = np.linalg.eigh(hess / np.outer(size, size))
    held = values > 1e-11 * max(float(values[-1]), 1e-300)
    slope = vectors.T @ (grad / size)
    if (np.abs(slope[~held]) > 1e-6 * math.sqrt(max(n, 1.0))).any():
        return None, math.inf
    move = np.where(held, slope / np.where(held, values, 1.0), 0.0)
    return (vectors @ move) / size, math.sqrt(max(0.0, float(slope @ move)))


def newton_next(grad: np.ndarray, hess: np.ndarray, n: float, lightest: float, epsilon: float) -> tuple[str, np.ndarray | None, float]:
    """(what, step, safe length) at coefficients where every intensity is positive.

    ``what``: "end" (the step is below ``epsilon`` standard errors), "endless" (there is no least value), "step" (so
    short that all of it keeps every intensity positive and lowers the value: the function is self-concordant) or "search".
    """
    step, decrement = newton_direction(grad, hess, n)
    if step is None:
        return "endless", None, 0.0
    if decrement < epsilon:
        return "end", step, 0.0
    scaled = decrement / math.sqrt(min(1.0, lightest)) if lightest > 0 else math.inf
    return ("step" if scaled < 0.25 else "search"), step, 1 / (1 + scaled)


def newton_length(values: np.ndarray, lengths: np.ndarray, here: float, slope: float, falling: float, changing: float) -> float | None:
    """The length of ``lengths`` with the least of ``values`` (inf: an intensity is not positive); 0 if none is below ``here``.

    None if the value falls for ever along the step: no intensity falls (``falling`` of ``changing``, sums of relative
    changes, is nothing) and the integral does not grow (``slope`` >= 0).
    """
    if slope >= -1e-12 * changing and falling <= 1e-10 * changing:
        return None
    best = int(np.argmin(values))
    return float(lengths[best]) if values[best] < here else 0.0


def newton_best(x: np.ndarray, weight: np.ndarray, integral: np.ndarray, steps: int = 100, epsilon: float = 1e-7, offset: np.ndarray | None = None) -> dict:
    """The coefficients with the least -sum w log(x b + offset) + b.integral with every intensity positive; column 0 is constant.

    Newton's method from a constant rate, with line searches while steps are long. The value is convex, so where it has
    a least value that is found; where it has none, ``note`` says so and there are no coefficients.
    """
    k, n = x.shape[1], float(weight.sum())
    b = np.zeros(k)
    offset = np.zeros(len(x)) if offset is None else offset
    b[0] = n / integral[0] - min(0.0, float(offset.min()))
    lightest, note = float(weight.min()), UNSETTLED
    out = {"beta": None, "hessian": None, "nll": None, "n_iter": 0, "converged": False, "note": None}
    some = [slice(i, i + ROWS) for i in range(0, len(x), ROWS)]
    for it in range(steps + 1):
        lam = x @ b + offset
        value, grad, hess = float(b @ integral), integral.astype(float), np.zeros((k, k))
        for at in some:
            z, w = x[at] / lam[at, None], weight[at]
            value, grad, hess = value - float((w * np.log(lam[at])).sum()), grad - w @ z, hess + (z * w[:, None]).T @ z
        out["n_iter"] = it
        what, step, safe = newton_next(grad, hess, n, lightest, epsilon)
        if what == "end":
            return out | {"beta": b, "hessian": hess, "nll": value, "converged": True}
        if what == "endless":
            note = ENDLESS
            break
        length = 1.0
        if what == "search":
            fall = x @ step
            lengths = np.array([*LENGTHS, safe])
            values = b @ integral - lengths * (step @ integral)
            for at in some:
                for i, s in enumerate(lengths):
                    if values[i] < np.inf:
                        to = lam[at] - s * fall[at]
                        values[i] = values[i] - weight[at] @ np.log(to) if to.min() > 0 else np.inf
            relative = weight * fall / lam
            length = newton_length(values, lengths, value, float(step @ integral), float(np.maximum(relative, 0).sum()), float(np.abs(relative).sum()))
            if length is None:
                note = ENDLESS
                break
            if length == 0:
                break
        b = b - length * step
    return out | {"note": note}


def newton_exp(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, steps: int = 100, epsilon: float = 1e-8) -> dict:
    """The coefficients with the least sum of exposure exp(x b) - y x b: an exponential link, by Newton steps that are
    halved until the value does not rise. ``x``: a constant first."""
    b = np.zeros(x.shape[1])
    b[0] = math.log(max(y.sum(), 0.5) / exposure.sum())
    value = lambda b: float((exposure * np.exp(np.minimum(x @ b, 50))).sum() - y @ (x @ b))
    now, done = value(b), False
    for _ in range(steps):
        mu = exposure * np.exp(np.minimum(x @ b, 50))
        step = np.linalg.lstsq((x * mu[:, None]).T @ x + 1e-9 * np.eye(len(b)), x.T @ (y - mu), rcond=None)[0]
        while np.abs(step).sum() >= epsilon and value(b + step) > now:
            step /= 2
        b, now = b + step, value(b + step)
        if np.abs(step).sum() < epsilon:
            done = True
            break
    return {"beta": b, "nll": now, "converged": done}


def newton_many(x: np.ndarray, weight: np.ndarray, time: float, steps: int = 60, rate: float = 0.9, epsilon: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, converged) of many fits with the same events: ``x`` is fit x column x event, a constant comes first.

    Steps are those of newton(); fits that have converged are left alone. A fit's events are worked on some at a time, in
    memory that is taken once.
    """
    fits, k = x.shape[0], x.shape[1] + 1
    b, done = np.full((fits, k), 0.1), np.zeros(fits, bool)
    b[:, 0] = weight.sum() / time
    grad, hess = np.empty((fits, k)), np.empty((fits, k, k))
    total = np.zeros(k)
    total[0] = time
    some = [slice(i, i + AT_WORK) for i in range(0, x.shape[2], AT_WORK)]
    lam, share, turned = np.empty((3, AT_WORK))
    for _ in range(steps):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        for i in open_.tolist():
            g, h = total.copy(), np.zeros((k, k))
            for at in some:
                z, w = x[i, :, at], weight[at]
                r, v, u = lam[: len(w)], share[: len(w)], turned[: len(w)]
                np.matmul(b[i, 1:], z, out=r)
                r += b[i, 0]
                if r.min() > 0:
                    np.divide(1.0, r, out=r)
                else:
                    np.divide(1.0, r, out=r, where=r > 0)
                    np.maximum(r, 0.0, out=r)  # what is not positive was left as it is
                np.multiply(w, r, out=v)
                g[0] -= v.sum()
                g[1:] -= z @ v
                v *= r
                h[0, 0] += v.sum()
                for p in range(k - 1):  # a product of two thin matrices takes three times as long
                    np.multiply(z[p], v, out=u)
                    h[0, p + 1] += u.sum()
                    for q in range(p, k - 1):
                        h[p + 1, q + 1] += u @ z[q]
            grad[i], hess[i] = g, np.triu(h) + np.triu(h, 1).T
        ridge = np.where(np.linalg.matrix_rank(hess[open_]) == k, 0, 0.01)
        step = np.linalg.solve(hess[open_] + ridge[:, None, None] * np.eye(k), grad[open_][..., None])[..., 0]
        size = np.abs(step).sum(axis=1)
        step *= (rate * np.where(size > 5, 5 / np.maximum(size, 5), 1))[:, None]
        b[open_] -= step
        done[open_] = np.abs(step).sum(axis=1) < epsilon
    return b, done


def norm_cdfs(x: np.ndarray) -> np.ndarray:
    """The Normal distribution by the approximation of functions.columns, for arrays."""
    t = 1 / (1 + NORMAL_T * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * sum(c * t ** (i + 1) for i, c in enumerate(NORMAL))
    return np.where(x >= 0, 1 - tail, tail)
