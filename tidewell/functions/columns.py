"""Column functions that SQL engines can repeat to the last digits that matter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation 26.2.17 of the Normal distribution (error below 7.5e-8): fixed values.
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_T = 0.2316419


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from an MD5 of the parts, joined by '/': repeatable in any partition and engine."""
    columns = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    t = 1 / (1 + NORMAL_T * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(NORMAL):
        poly = (poly + c) * t
    tail = norm_pdf(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


#: Coefficients of Hart's rational approximation 5666 of the Normal tail (15 digits), highest power first: fixed values.
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: From here on a continued fraction is used.
TAIL_FAR = 7.07106781186547


def norm_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 15 digits."""
    above = below = F.lit(0.0)
    for c in TAIL_ABOVE:
        above = above * z + c
    for c in TAIL_BELOW:
        below = below * z + c
    far = z
    for k in range(20, 0, -1):
        far = z + k / far
    return F.exp(-z * z / 2) * F.when(z < TAIL_FAR, above / below).otherwise(1 / far / math.sqrt(2 * math.pi))


def sql_norm_tail(z: str) -> str:
    above = below = "CAST(0 AS DOUBLE)"
    for c in TAIL_ABOVE:
        above = f"({above} * {z} + CAST({c!r} AS DOUBLE))"
    for c in TAIL_BELOW:
        below = f"({below} * {z} + CAST({c!r} AS DOUBLE))"
    far = z
    for k in range(20, 0, -1):
        far = f"({z} + {k} / {far})"
    return f"(exp(-{z} * {z} / 2) * CASE WHEN {z} < {TAIL_FAR!r} THEN {above} / {below} ELSE 1 / {far} / {math.sqrt(2 * math.pi)!r} END)"


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X > x) of chi-square with any whole degrees of freedom, by its finite sums; 1 where x or dof is 0."""
    h, one = x / 2, F.lit(1.0)
    odd = dof % 2 == 1
    terms = F.floor(dof / 2).cast("int")
    step = F.when(odd, 0.5).otherwise(0.0)
    more = F.when(terms > 1, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    sums = F.aggregate(more, F.struct(one.alias("term"), one.alias("sum")), lambda a, k: F.struct(
        (a["term"] * h / (k + step)).alias("term"), (a["sum"] + a["term"] * h / (k + step)).alias("sum")))["sum"]
    first = F.exp(-h) * F.when(odd, F.sqrt(h) * (2 / math.sqrt(math.pi))).otherwise(one)
    tail = F.when(odd, 2 * norm_tail(F.sqrt(x))).otherwise(0.0) + F.when(terms > 0, first * sums).otherwise(0.0)
    return F.when((dof <= 0) | (x <= 0), one).otherwise(F.least(tail, one))


def sql_chi2_tail(x: str, dof: str) -> str:
    half, odd = f"(({x}) / 2)", f"({dof} % 2)"
    sums = f"coalesce(list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), lambda k: exp(-{half} + (k + 0.5 * {odd}) * ln({half}) - lgamma(k + 1 + 0.5 * {odd})))), 0)"
    return f"(CASE WHEN {dof} <= 0 OR {x} <= 0 THEN 1.0 ELSE least(1.0, CASE WHEN {odd} = 1 THEN 2 * {sql_norm_tail(f'sqrt({x})')} ELSE 0.0 END + {sums}) END)"


def corr(x: str, y: str) -> Column:
    """Pearson's r; null where a side doesn't vary."""
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 0, F.covar_pop(x, y) / F.when(sd > 0, sd))


def laplace_pdf(x: Column, scale: float) -> Column:
    return F.exp(-F.abs(x) / scale) / (2 * scale)




def sql_norm_cdf(x: str) -> str:
    t = f"(1 / (1 + {NORMAL_T} * abs({x})))"
    poly = "0.0"
    for c in reversed(NORMAL):
        poly = f"({poly} + {c}) * {t}"
    tail = f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)!r} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_uniform(s: str) -> str:
    return f"(CAST(('0x' || substr(md5({s}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def sql_corr(x: str, y: str) -> str:
    return f"(CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END)"
