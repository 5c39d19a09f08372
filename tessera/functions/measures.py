"""Statistics on contingency counts, as column expressions; tails of distributions as Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def signed_chi2(k: Column, row: Column, col: Column, total: Column) -> Column:
    """Chi-square of a 2x2 table without correction, negative where the count is below its expectation. k in the cell, its row and column sums, the total."""
    k, row, col, total = (x.cast("double") for x in (k, row, col, total))
    det = k * total - row * col
    den = row * col * (total - row) * (total - col)
    chi2 = ratio(total * det * det, den)
    return F.when(k * total >= row * col, chi2).otherwise(-chi2)


def signed_g2(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Log-likelihood ratio of a term's counts in two corpora, negative where it is rarer in the first."""
    a, b, c, d = (x.cast("double") for x in (a, b, size_a, size_b))
    ea, eb = c * (a + b) / (c + d), d * (a + b) / (c + d)
    g2 = 2 * (F.when(a > 0, a * F.log(a / ea)).otherwise(0.0) + F.when(b > 0, b * F.log(b / eb)).otherwise(0.0))
    return F.when(a >= ea, g2).otherwise(-g2)


def per(count: Column, size: Column, unit: float) -> Column:
    return ratio(count * F.lit(unit), size)


_LOG_GAMMA = np.array([math.inf, *(math.lgamma(k) for k in range(1, 1024))])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function at positive integers: a table, and Stirling's series above it."""
    x = np.asarray(x)
    z = np.maximum(x, 1023).astype(float)
    far = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(x < 1024, _LOG_GAMMA[np.minimum(x, 1023).astype(np.int64)], far)


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def hypergeometric_tail(k: int, row: int, col: int, total: int) -> float:
    """-log10 of the tail beyond a count: P(X >= k) positive if the count is at least its expectation, else P(X <= k) negative. Floor 1e-300."""
    up = k * total >= row * col
    low, high = max(0, row + col - total), min(row, col)
    xs = np.arange(k, high + 1) if up else np.arange(low, k + 1)
    base = math.lgamma(total + 1) - math.lgamma(row + 1) - math.lgamma(total - row + 1)
    n = np.full(len(xs), col)
    logs = _log_choose(n, xs) + _log_choose(np.full(len(xs), total - col), row - xs) - base
    top = logs.max()
    p = min(1.0, max(1e-300, math.exp(top) * float(np.exp(logs - top).sum())))
    return -math.log10(p) if up else math.log10(p)


@F.pandas_udf(T.DoubleType())
def signed_hypergeometric(k: pd.Series, row: pd.Series, col: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, row, col, total)])


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square >= x): the regularised upper incomplete gamma function by series or continued fraction."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, x = dof / 2, x / 2
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * lead)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(a), int(b)) for a, b in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def binomial_below(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k) of a binomial distribution; 0 for k < 0."""

    def below(k: int, n: int, p: float) -> float:
        if k < 0:
            return 0.0
        if p <= 0 or k >= n:
            return 1.0
        if p >= 1:
            return 0.0
        xs = np.arange(0, k + 1)
        logs = _log_choose(np.full(len(xs), n), xs) + xs * math.log(p) + (n - xs) * math.log1p(-p)
        top = logs.max()
        return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))

    return pd.Series([below(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)])
