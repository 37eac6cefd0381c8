"""Special functions in numpy, for use inside pandas UDFs and grouped kernels on the executors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, n = 9.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x):
    """log gamma for x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    total = _LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    value = 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * x))) - value, value)


def digamma(x):
    """Derivative of lgamma for x > 0: by its recurrence up to x + 8, and the asymptotic series there."""
    x = np.asarray(x, float)
    low = sum(1 / (x + i) for i in range(8))
    z = x + 8
    f = 1 / (z * z)
    return np.log(z) - 0.5 / z - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240))) - low


def gammas(x):
    """lgamma and its first two derivatives for x > 0, each by its recurrence up to x + 8 and the asymptotic series there."""
    x = np.asarray(x, float)
    product, low, lower = np.ones_like(x), np.zeros_like(x), np.zeros_like(x)
    for i in range(8):
        at = x + i
        product *= at
        part = 1 / at
        low += part
        lower += part * part
    z = x + 8
    log, r = np.log(z), 1 / z
    f = r * r
    value = (z - 0.5) * log - z + 0.5 * np.log(2 * np.pi) + r * (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f / 1188)))) - np.log(product)
    first = log - 0.5 * r - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - low
    return value, first, r + 0.5 * f + r * f * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66)))) + lower


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    part = np.where(low, front * _beta_fraction(a, b, np.where(low, inside, 0.1)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.1, 1 - inside)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, part))


def gammainc_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - lgamma(a))
    low = safe < a + 1
    every, safe = safe, np.where(low, safe, a)  # each expansion sees only the side where it converges soon
    term, total = 1 / a, 1 / a
    for n in range(1, 1000):
        term = term * safe / (a + n)
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * 1e-16):
            break
    lower = front * total
    safe = np.where(low, a + 2, every)
    b = safe + 1 - a
    c, d = np.full_like(safe, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d.copy()
    for i in range(1, 1000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(low, 1 - lower, front * h))


def t_sf2(t, df):
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f = np.maximum(np.asarray(f, float), 0)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    return gammainc_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def log_choose(n, k):
    return lgamma(np.asarray(n, float) + 1) - lgamma(np.asarray(k, float) + 1) - lgamma(np.asarray(n, float) - k + 1)


def hypergeom_sf(k, total, marked, drawn):
    """P(X > k) for X marked among `drawn` of `total`."""
    lo, hi = max(int(k) + 1, int(drawn + marked - total), 0), int(min(drawn, marked))
    if lo > hi:
        return 0.0
    x = np.arange(lo, hi + 1)
    return float(min(1.0, np.exp(log_choose(marked, x) + log_choose(total - marked, drawn - x) - log_choose(total, drawn)).sum()))


def binom_sf(k, n, p):
    """P(X > k) of the binomial."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k < 0, 1.0, np.where(k >= n, 0.0, betainc(np.maximum(k, 0) + 1, np.maximum(n - k, 1e-9), p)))


_erfc = np.frompyfunc(math.erfc, 1, 1)


def norm_sf(x):
    return 0.5 * np.asarray(_erfc(np.asarray(x, float) / math.sqrt(2)), float)


def norm_pdf(x, mean=0.0, sd=1.0):
    return np.exp(-0.5 * ((np.asarray(x, float) - mean) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def norm_ppf(p):
    """Inverse normal: a rational start, then Newton steps."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    low = p < 0.5
    x = np.where(low, -x, x)
    for _ in range(4):
        tail = norm_sf(np.where(low, -x, x))  # only the side that is used
        x = x - np.where(low, tail - p, (1 - p) - tail) / np.maximum(norm_pdf(x), 1e-300)
    return x


def gumbel_cdf(x, mu, beta):
    return np.exp(-np.exp(-(np.asarray(x, float) - mu) / beta))


def gumbel_pdf(x, mu, beta):
    z = (np.asarray(x, float) - mu) / beta
    return np.exp(-z - np.exp(-z)) / beta


def geom_ppf(q, p):
    return np.ceil(np.log1p(-np.asarray(q, float)) / np.log1p(-p))


def _column(kernel, *args):
    """A scalar pandas UDF over double columns; null arguments give null."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        frame = pd.concat(series, axis=1).astype(float)
        ok = frame.notna().all(axis=1)
        out = pd.Series(np.nan, index=frame.index, dtype=float)
        if ok.any():
            out[ok] = kernel(*(frame.loc[ok].iloc[:, i].to_numpy() for i in range(frame.shape[1])))
        return out.where(out.notna(), None)

    return run(*args)


def f_sf_column(f, d1, d2):
    return _column(f_sf, f, d1, d2)


def t_sf2_column(t, df):
    return _column(t_sf2, t, df)


def chi2_sf_column(x, df):
    return _column(chi2_sf, x, df)


def norm_sf_column(x):
    return _column(norm_sf, x)


def hypergeom_sf_column(k, total, marked, drawn):
    return _column(np.vectorize(hypergeom_sf), k, total, marked, drawn)
