"""Tail areas of t, F and studentised range as column expressions: fixed quadrature sums, evaluated in the JVM.

No gamma function is needed, as every density is divided by its own integral, and the number of terms does not
depend on the degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, functions as F

# trapezoids in the logarithm of the distance, from e^-40 to e^5, all distances that matter for up to 1e10 degrees of freedom
STEP = 0.125
FIRST, LAST = -320, 40
NEWTON_STEPS = 8

# fixed values: Hart's rational approximation of the normal tail, highest power first
HART_ABOVE = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
)
HART_BELOW = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
)


def _half_line(log_height: Callable[[Column], Column]) -> Column:
    """The integral of exp(log_height(s)) over s > 0, for a height that falls."""

    def add(total: Column, i: Column) -> Column:
        u = i * F.lit(STEP)
        return total + F.exp(log_height(F.exp(u)) + u)

    return F.aggregate(F.sequence(F.lit(FIRST), F.lit(LAST)), F.lit(0.0), add) * F.lit(STEP)


class _LogF:
    """The density of the logarithm of F, as a multiple of its height at its mode, which is 0."""

    def __init__(self, df1: Column, df2: Column):
        # the rates at which it falls below and above the mode
        self.low, self.high = df1.cast("double") / 2.0, df2.cast("double") / 2.0
        self.total = self.area(self.low, F.lit(0.0)) + self.area(self.high, F.lit(0.0))

    def log_height(self, rate: Column, distance: Column) -> Column:
        both = self.low + self.high
        return -rate * distance - both * F.log1p(rate / both * F.expm1(-distance))

    def area(self, rate: Column, distance: Column) -> Column:
        """What lies further from the mode, on one side."""
        return _half_line(lambda s: self.log_height(rate, distance + s))

    def upper(self, z: Column) -> Column:
        below = 1.0 - self.area(self.low, -z) / self.total
        return F.when(z >= 0, self.area(self.high, z) / self.total).otherwise(below)

    def density(self, z: Column) -> Column:
        height = F.when(z >= 0, self.log_height(self.high, z)).otherwise(self.log_height(self.low, -z))
        return F.exp(height) / self.total


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of F; missing without degrees of freedom."""
    tail = F.when(f <= 0, F.lit(1.0)).when(f > 0, _LogF(df1, df2).upper(F.log(f)))
    return F.when((df1 > 0) & (df2 > 0), tail)


def t_p_value(t: Column, df: Column) -> Column:
    """Both tails of t: its square is an F with one degree of freedom."""
    return f_p_value(t * t, F.lit(1.0), df)


def t_quantile(level: float, df: Column) -> Column:
    """The value that |t| exceeds with probability 1 - level, by Newton's method from the expansion of the normal quantile."""
    df = df.cast("double")
    x = NormalDist().inv_cdf((1.0 + level) / 2.0)
    powers = (x**3 + x) / 4, (5 * x**5 + 16 * x**3 + 3 * x) / 96, (3 * x**7 + 19 * x**5 + 17 * x**3 - 15 * x) / 384
    start = F.lit(x) + F.lit(powers[0]) / df + F.lit(powers[1]) / (df * df) + F.lit(powers[2]) / (df * df * df)
    curve = _LogF(F.lit(1.0), df)

    def improved(t: Column, _: Column) -> Column:
        z = F.log(t) * 2.0
        return t + (curve.upper(z) - F.lit(1.0 - level)) * t / (curve.density(z) * 2.0)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, improved)
    known = F.when(df == 1, F.lit(math.tan(math.pi * level / 2.0))).when(df == 2, F.lit(level * math.sqrt(2.0 / (1.0 - level * level))))
    return F.when(df > 0, known.otherwise(found))


def normal_below(x: Column) -> Column:
    """The normal distribution function, to about 1e-14 within 7 deviations and as 0 or 1 further out."""
    size = F.abs(x)
    above, below = F.lit(HART_ABOVE[0]), F.lit(HART_BELOW[0])
    for c in HART_ABOVE[1:]:
        above = above * size + F.lit(c)
    for c in HART_BELOW[1:]:
        below = below * size + F.lit(c)
    tail = F.when(size < 7.0, F.exp(size * size / -2.0) * above / below).otherwise(F.lit(0.0))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def _nodes(count: int, *columns: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    x, w = np.polynomial.legendre.leggauss(count)
    values = [f(x, w) for f in columns]
    return F.array(*[F.struct(*[F.lit(float(v[i])).alias(f"c{j}") for j, v in enumerate(values)]) for i in range(count)])


def range_p_value(q: Column, groups: Column, df: Column) -> Column:
    """Upper tail of the studentised range, over the greatest of the normal values and the estimate of their deviation."""
    q, groups, df = q.cast("double"), groups.cast("double"), df.cast("double")
    normal = NormalDist()
    # value, weight with its density, distribution function
    values = _nodes(
        96,
        lambda x, w: x * 8.0,
        lambda x, w: w * 8.0 * np.exp(-32.0 * x * x) / math.sqrt(2.0 * math.pi),
        lambda x, w: np.array([normal.cdf(v) for v in x * 8.0]),
    )
    spans = _nodes(48, lambda x, w: (x + 1.0) / 2.0, lambda x, w: w)

    def within(width: Column) -> Column:
        def add(total: Column, v: Column) -> Column:
            return total + v["c1"] * F.pow(F.greatest(F.lit(0.0), v["c2"] - normal_below(v["c0"] - width)), groups - 1.0)

        return groups * F.aggregate(values, F.lit(0.0), add)

    reach = F.lit(8.0) / F.sqrt(df * 2.0)
    low = F.greatest(F.lit(1e-6), 1.0 - reach)

    def weighed(part: Callable[[Column], Column]) -> Column:
        def add(total: Column, v: Column) -> Column:
            s = low + (1.0 + reach - low) * v["c0"]
            return total + v["c1"] * F.exp((df - 1.0) * F.log(s) - df * (s * s - 1.0) / 2.0) * part(s)

        return F.aggregate(spans, F.lit(0.0), add)

    inside = weighed(lambda s: within(q * s)) / weighed(lambda s: F.lit(1.0))
    tail = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - inside))
    return F.when(q.isNotNull() & (df > 0), tail)
