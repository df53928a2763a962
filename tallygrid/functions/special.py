"""Special functions that Spark lacks: log-gamma as a column, chi-square and normal laws, matrix exponential on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for log-gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def lgamma(x: Column) -> Column:
    """log-gamma of a positive column: the argument is shifted up by 8, where the series is exact to the last bits."""
    x = x.cast("double")
    z = x + 8
    series = sum((F.lit(c) / F.pow(z, 2 * i + 1) for i, c in enumerate(STIRLING)), F.lit(0.0))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    x = np.asarray(x, dtype=float)
    z = x + 8
    series = sum(c / z ** (2 * i + 1) for i, c in enumerate(STIRLING))
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: by its series below a + 1, by a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-square law."""
    return 1.0 if dof <= 0 else gamma_q(dof / 2, x / 2)


def chi2_isf(p: float, dof: float) -> float:
    """The value with upper tail ``p``, by bisection."""
    low, high = 0.0, dof + 10.0
    while chi2_sf(high, dof) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf(mid, dof) > p else (low, mid)
    return (low + high) / 2


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(x)


def norm_ppf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(p)


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor polynomial, and squaring."""
    scale = max(0, math.ceil(math.log2(max(np.abs(a).sum(axis=1).max(), 1e-300))) + 1)
    a = a / 2**scale
    out = term = np.eye(len(a))
    for i in range(1, 19):
        term = term @ a / i
        out = out + term
    for _ in range(scale):
        out = out @ out
    return out
