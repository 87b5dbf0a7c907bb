"""Tail probabilities and quantiles as Arrow column functions, for the small result tables of tests.

Spark has no error, gamma or beta functions of its own.  Nulls stay null.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
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
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or 1e-300)
            c = 1 + an / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def binomial_cdf(k: float, n: float, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else beta_cdf(1 - p, n - k, k + 1)


def binomial_two_sided(k: float, n: float, p: float) -> float:
    """Twice the smaller tail, 1 at most."""
    return min(1.0, 2 * min(binomial_cdf(k, n, p), 1 - binomial_cdf(k - 1, n, p)))


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    while hi - lo > 1e-14:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return (lo + hi) / 2


def chi2_quantile(q: float, df: float) -> float:
    lo, hi = 0.0, df + 1
    while chi2_tail(hi, df) > 1 - q:
        hi *= 2
    while hi - lo > 1e-10 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, df) > 1 - q else (lo, mid)
    return (lo + hi) / 2


def noncentral_chi2_tail(x: float, df: float, shift: float) -> float:
    """A Poisson mixture of chi-square tails around its mode."""
    half, total, mode = shift / 2, 0.0, int(shift / 2)
    weight = lambda j: math.exp(j * math.log(half) - half - math.lgamma(j + 1)) if half > 0 else float(j == 0)
    for step, start in ((1, mode), (-1, mode - 1)):
        j = start
        while j >= 0:
            w = weight(j)
            total += w * chi2_tail(x, df + 2 * j)
            if w < 1e-16:
                break
            j += step
    return min(1.0, total)


def shared_prize(pool: float, mu: float, cap: float) -> float:
    """E[min(cap, pool / (1 + X))] for Poisson X of mean mu, summed to mu + 10 sqrt(mu) + 20."""
    total, log_mu = 0.0, math.log(mu) if mu > 0 else 0.0
    for x in range(int(mu + 10 * math.sqrt(mu) + 20) + 1):
        p = math.exp(x * log_mu - mu - math.lgamma(x + 1)) if mu > 0 else float(x == 0)
        total += p * min(cap, pool / (1 + x))
    return total


def _column(f):
    @pandas_udf(DoubleType())
    def run(*args: pd.Series) -> pd.Series:
        values = np.column_stack([a.to_numpy(float) for a in args])
        return pd.Series([None if np.isnan(row).any() else f(*row) for row in values], dtype="float64")

    return run


norm_sf = _column(normal_sf)
norm_cdf = _column(lambda z: normal_sf(-z))
norm_two_sided = _column(lambda z: 2 * normal_sf(abs(z)))
norm_ppf = _column(_NORMAL.inv_cdf)
chi2_sf = _column(chi2_tail)
t_sf = _column(t_tail)
binom_cdf = _column(binomial_cdf)
binom_test = _column(binomial_two_sided)
beta_ppf = _column(beta_quantile)
ncx2_sf = _column(noncentral_chi2_tail)
share_expected = _column(shared_prize)


def register(spark) -> None:
    """The functions under their names in SQL."""
    for name in ("norm_sf", "norm_cdf", "norm_ppf", "chi2_sf", "t_sf", "binom_cdf", "binom_test", "beta_ppf", "ncx2_sf", "share_expected"):
        spark.udf.register(name, globals()[name])
