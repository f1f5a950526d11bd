"""Distribution functions behind the p-values.

Statistics are computed by Spark over all rows; what arrives here is one row per feature
or pair, as pandas batches. The normal distribution function is also needed per value
(normality tests) and is therefore a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cody's rational approximations of erf and erfc, highest power first.
_ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERFC_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
             8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_ERFC_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
             3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_TAIL_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
             1.60837851487422766e-2, 6.58749161529837803e-4)
_TAIL_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def log_normal_cdf(z: Column) -> Column:
    """Natural logarithm of the standard normal distribution function, good in both tails."""
    y = F.abs(z) / math.sqrt(2.0)
    square = y * y
    erf_part = y * _poly(square, _ERF_NUM) / _poly(square, _ERF_DEN)
    # erfc(y) = scaled(y) * exp(-y*y)
    middle = _poly(y, _ERFC_NUM) / _poly(y, _ERFC_DEN)
    inverse = 1 / square
    far = (1 / math.sqrt(math.pi) - inverse * _poly(inverse, _TAIL_NUM) / _poly(inverse, _TAIL_DEN)) / y
    scaled = F.when(y <= 4, middle).otherwise(far)
    return (
        F.when(y <= 0.46875, F.log(0.5 + 0.5 * F.signum(z) * erf_part))
        .when(z < 0, F.log(0.5 * scaled) - square)
        .otherwise(F.log1p(-0.5 * scaled * F.exp(-square)))
    )


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * scale


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1.0 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + numerator * d) or tiny)
            c = (1.0 + numerator / c) or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(dof / 2, x / 2) if dof > 0 else 1.0


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / 2, 0.5, dof / (dof + t * t))


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of the scaled two-sample distance."""
    if x <= 0.1:
        return 1.0
    if x < 1.0:  # the theta form converges fast for small arguments
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 12))
        return 1.0 - math.sqrt(2 * math.pi) / x * total
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: Samples up to this size have an exact distance test.
EXACT_DISTANCE = 10_000


def smirnov_sf(d: float, n1: int, n2: int) -> float:
    """Exact chance of a two-sample distance of ``d`` or more.

    Every order of the two samples is a lattice path from (0, 0) to (n1, n2), and the distance
    reaches ``d`` where the path comes far enough from the diagonal. Of the paths to a point with
    i of the first and j of the second sample a share i / (i + j) comes from the left, so the
    share of paths that have been far out follows diagonal by diagonal.
    """
    far = round(d * n1 * n2)
    if not far:
        return 1.0
    low = 0  # the first i on the diagonal
    share = np.zeros(1)
    for total in range(1, n1 + n2 + 1):
        first, last = max(0, total - n2), min(n1, total)
        i = np.arange(first, last + 1)
        here = np.zeros(len(i))
        # from the left: (i - 1, j), from below: (i, j - 1)
        left, below = i - 1 - low, i - low
        ok = (left >= 0) & (left < len(share))
        here[ok] += i[ok] / total * share[left[ok]]
        ok = (below >= 0) & (below < len(share)) & (total - i > 0)
        here[ok] += (total - i[ok]) / total * share[below[ok]]
        here[np.abs(i * n2 - (total - i) * n1) >= far] = 1.0
        share, low = here, first
    return float(share[0])


#: Samples up to this size without ties have an exact rank correlation test.
EXACT_INVERSIONS = 33


def inversions_at_most(n: int, k: int) -> float:
    """Share of the orders of ``n`` values that have ``k`` inversions or fewer.

    The ``m``-th value adds 0 to m - 1 inversions to those of the values before it, each as likely.
    """
    share = np.zeros(k + 1)
    share[0] = 1.0
    for m in range(2, n + 1):
        sums = np.cumsum(share)
        share = sums.copy()
        share[m:] -= sums[:-m] if m <= k else 0.0
        share /= m
        if m > k + 1 and share.sum() == 0:
            return 0.0
    return float(min(share.sum(), 1.0))


def kendall_sf(n: float, swaps: float, net: float, variance: float, ties: float) -> float:
    """Two-sided p of Kendall's tau: exact for small samples without ties, else normal with the variance of the ties."""
    most = n * (n - 1) / 2
    fewer = min(swaps, most - swaps)
    if ties == 0 and (n <= EXACT_INVERSIONS or fewer <= 1):
        return min(1.0, 2 * inversions_at_most(int(n), int(fewer)))
    return 2 * normal_sf(abs(net) / math.sqrt(variance)) if variance > 0 else math.nan


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _piecewise(low: float, high: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.linspace(low, high, parts + 1)
    half = np.diff(edges) / 2
    middle = edges[:-1] + half
    return (middle[:, None] + half[:, None] * _NODES).ravel(), (half[:, None] * _WEIGHTS).ravel()


_ERF = np.frompyfunc(math.erf, 1, 1)


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(z / math.sqrt(2.0)).astype(float))


def _range_cdf(q: float, k: int) -> float:
    z, w = _piecewise(-8.0, 8.0, 4)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float(k * np.sum(w * density * (_phi(z) - _phi(z - q)) ** (k - 1)))


def studentized_range_sf(q: float, k: int, dof: float) -> float:
    """Upper tail of the studentized range of ``k`` means."""
    if q <= 0:
        return 1.0
    # s = chi / sqrt(dof) is close to a normal around 1
    reach = 10 / math.sqrt(2 * dof)
    s, w = _piecewise(max(1e-9, 1 - reach), 1 + reach + (1 if dof < 20 else 0), 1)
    half = dof / 2
    if dof < 2000:
        scale = half * math.log(half) - math.lgamma(half) - half
    else:  # Stirling's series: the terms above are large and nearly cancel
        scale = 0.5 * math.log(half) - 0.5 * math.log(2 * math.pi) - 1 / (12 * half) + 1 / (360 * half**3)
    shift = s - 1
    log_density = math.log(2) + scale + dof * (np.log1p(shift) - shift - shift * shift / 2) - np.log(s)
    return max(0.0, 1.0 - float(np.sum(w * np.exp(log_density) * [_range_cdf(q * v, k) for v in s])))


def studentized_range_quantile(p: float, k: int, dof: float) -> float:
    """Value that the studentized range exceeds with probability ``1 - p``."""
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2
        if studentized_range_sf(middle, k, dof) > 1 - p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _rowwise(fn, *args: pd.Series) -> pd.Series:
    return pd.Series(
        [fn(*map(float, row)) if all(pd.notna(v) for v in row) else None for row in zip(*args)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(chi2_sf, x, dof)


@F.pandas_udf(T.DoubleType())
def f_p(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(f_sf, x, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rowwise(lambda v: 2 * normal_sf(abs(v)), z)


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(x: pd.Series) -> pd.Series:
    return _rowwise(kolmogorov_sf, x)


@F.pandas_udf(T.DoubleType())
def distance_p(d: pd.Series, n1: pd.Series, n2: pd.Series, exact_up_to: pd.Series) -> pd.Series:
    def one(d: float, n1: float, n2: float, most: float) -> float:
        return smirnov_sf(d, int(n1), int(n2)) if max(n1, n2) <= most else kolmogorov_sf(d * math.sqrt(n1 * n2 / (n1 + n2)))

    return _rowwise(one, d, n1, n2, exact_up_to)


@F.pandas_udf(T.DoubleType())
def kendall_p(n: pd.Series, swaps: pd.Series, net: pd.Series, variance: pd.Series, ties: pd.Series) -> pd.Series:
    return _rowwise(kendall_sf, n, swaps, net, variance, ties)


@F.pandas_udf(T.DoubleType())
def tukey_p(q: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(lambda a, b, c: studentized_range_sf(a, int(b), c), q, k, dof)


@F.pandas_udf(T.DoubleType())
def tukey_critical(p: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}

    def once(a: float, b: float, c: float) -> float:
        if (a, b, c) not in seen:
            seen[a, b, c] = studentized_range_quantile(a, int(b), c)
        return seen[a, b, c]

    return _rowwise(once, p, k, dof)


def _royston(w: float, n: float) -> float:
    """Royston's normalising transformation of the Shapiro-Wilk statistic."""
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0
    # Royston (1995), lowest power first.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if gamma <= math.log1p(-w):
            return 0.0
        y = -math.log(gamma - math.log1p(-w))
        mean = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 6.714e-4 * n**3
        std = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        size = math.log(n)
        y = math.log1p(-w)
        mean = -1.5861 - 0.31082 * size - 0.083751 * size**2 + 0.0038915 * size**3
        std = math.exp(-0.4803 - 0.082676 * size + 0.0030302 * size**2)
    return normal_sf((y - mean) / std)


@F.pandas_udf(T.DoubleType())
def royston_p(w: pd.Series, n: pd.Series) -> pd.Series:
    return _rowwise(_royston, w, n)
