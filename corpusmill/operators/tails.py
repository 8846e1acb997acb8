"""Tails of the normal, t, chi-square and studentised range distributions, for rows of results: a handful of numbers, never data."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t that has the probability p below it, for p above one half."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def chi2_tail(x: float, k: float) -> float:
    """Probability above x: the upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return 1 - total * front
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def range_tail(q: float, k: int) -> float:
    """Probability that the range of k standard normal values is above q: k times the integral of the density times the share within q below, by Simpson's rule."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8.0, 8.0 + q, 4001)
    cdf = np.array([NORMAL.cdf(v) for v in z])
    low = np.array([NORMAL.cdf(v - q) for v in z])
    y = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (cdf - low) ** (k - 1)
    w = np.ones(len(z))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return max(0.0, 1 - float((w * y).sum() * (z[1] - z[0]) / 3))


def range_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - range_tail(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def column(f, *cols) -> Column:
    """f of a few columns of doubles, null where one of them is; for tables of results."""

    @F.pandas_udf("double")
    def g(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(f(*row)) for row in zip(*xs, strict=True)], dtype="float64")

    return g(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in cols])


def z_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
