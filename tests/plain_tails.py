"""Tail areas as plain Python: continued fraction, bisection, numpy quadrature. The column expressions must agree."""

from __future__ import annotations

import math

import numpy as np


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        change = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            total *= change
        if abs(change - 1.0) < 1e-14:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return f_upper(t * t, 1.0, df)


def f_upper(f: float, df1: float, df2: float) -> float:
    if f * df1 < df2:  # the other share would lose digits
        return 1.0 - beta_share(df1 * f / (df2 + df1 * f), df1 / 2.0, df2 / 2.0)
    return beta_share(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def t_critical(level: float, df: float) -> float:
    """Two-sided critical value by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def range_upper(q: float, groups: int, df: float) -> float:
    """Upper tail of the studentised range, integrated over the normal and the chi distribution."""
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = z * 8.0, wz * 8.0
    density = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    cumulative = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)))

    def below(w: float) -> float:
        spread = cumulative(z) - cumulative(z - w)
        return float(groups * np.sum(wz * density * spread ** (groups - 1)))

    half = 8.0 / math.sqrt(2.0 * df)
    s, ws = np.polynomial.legendre.leggauss(48)
    low, high = max(1e-6, 1.0 - half), 1.0 + half
    s, ws = low + (high - low) * (s + 1.0) / 2.0, ws * (high - low) / 2.0
    log_density = (
        math.log(2.0) + df / 2.0 * math.log(df / 2.0) - math.lgamma(df / 2.0) + (df - 1.0) * np.log(s) - df * s * s / 2.0
    )
    inside = sum(w * math.exp(ld) * below(q * x) for x, w, ld in zip(s, ws, log_density))
    return min(1.0, max(0.0, 1.0 - inside))
