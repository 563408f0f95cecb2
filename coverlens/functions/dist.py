"""Tails of t, chi-square, F, normal and noncentral t, and small exact rank distributions.

They run on one row per group, after the data has been reduced by native aggregates.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        c = np.ones_like(xx)
        d = 1.0 / np.where(np.abs(1.0 - (aa + bb) * xx / (aa + 1.0)) < 1e-300, 1e-300, 1.0 - (aa + bb) * xx / (aa + 1.0))
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1.0 + num / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-16):
                break
        out = np.where(xx <= 0, 0.0, front * h)
    return np.where(flip, 1.0 - out, out)


def t_sf(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return np.where(t >= 0, tail, 1.0 - tail)


def t_ppf(p, df):
    """Quantile by bisection on the tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(60):
        lo, hi = np.where(t_sf(lo, df) < 1 - p, lo * 2, lo), np.where(t_sf(hi, df) > 1 - p, hi * 2, hi)
        if np.all((t_sf(lo, df) >= 1 - p) & (t_sf(hi, df) <= 1 - p)):
            break
    for _ in range(90):
        mid = (lo + hi) / 2
        up = t_sf(mid, df) > 1 - p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def gammaincc(a, x):
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1.0 / a
        total = term.copy()
        for k in range(1, 1000):
            term = term * x / (a + k)
            total = total + term
            if np.all(np.abs(term) < 1e-17 * np.abs(total)):
                break
        low = 1.0 - front * total
        b = x + 1.0 - a
        c = np.full_like(x, 1e300)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, 1000):
            an = -k * (k - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-16):
                break
        high = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1.0, low, high))


def chi2_sf(x, df):
    return gammaincc(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def f_sf(f, d1, d2):
    f, d1, d2 = np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float)
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def nct_cdf(t, df, ncp):
    """P(T <= t) as the mean of the normal tail over the chi density of the scale, by Gauss-Legendre on +-12 sd."""
    t, df, ncp = (np.asarray(v, float)[..., None] for v in (t, df, ncp))
    sd = 1.0 / np.sqrt(2.0 * df)
    lo, hi = np.maximum(1.0 - 12.0 * sd, 1e-12), 1.0 + 12.0 * sd
    s = lo + (hi - lo) * (_NODES + 1.0) / 2.0
    log_density = math.log(2.0) + (df / 2.0) * np.log(df / 2.0) - _lgamma(df / 2.0) + (df - 1.0) * np.log(s) - df * s * s / 2.0
    return np.sum(np.exp(log_density) * norm_sf(ncp - t * s) * _WEIGHTS * (hi - lo) / 2.0, axis=-1)


def power_t(d, n1, n2, alpha):
    """Power of the two-sided two-sample t test; 0 without effect or data, 1 for a huge shift."""
    d, n1, n2, alpha = np.broadcast_arrays(*(np.asarray(v, float) for v in (np.abs(d), n1, n2, alpha)))
    ok = (d > 0) & (n1 >= 2) & (n2 >= 2)
    df = np.where(ok, n1 + n2 - 2, 2.0)
    ncp = np.where(ok, d * np.sqrt(n1 * n2 / np.maximum(n1 + n2, 1.0)), 0.0)
    return np.where(ok, _power_at(ncp, df, t_ppf(1 - alpha / 2, df)), 0.0)


def _power_at(ncp, df, crit):
    """Power at a given shift; beyond a shift of 37 it is 1."""
    small = np.minimum(ncp, 37.0)
    return np.where(ncp > 37, 1.0, 1.0 - nct_cdf(crit, df, small) + nct_cdf(-crit, df, small))


def _nullable(fn):
    """Vectorised function over columns; rows with any null give null."""

    def call(*cols: pd.Series) -> pd.Series:
        frame = pd.concat(cols, axis=1).astype(float)
        ok = frame.notna().all(axis=1).to_numpy()
        out = np.full(len(frame), np.nan)
        if ok.any():
            out[ok] = fn(*[frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])])
        return pd.Series(out).astype("Float64")

    return call


@F.pandas_udf(DoubleType())
def t_ppf_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_ppf)(p, df)


@F.pandas_udf(DoubleType())
def t_sf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_sf)(t, df)


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(chi2_sf)(x, df)


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _nullable(f_sf)(f, d1, d2)


@F.pandas_udf(DoubleType())
def norm_two_sided_udf(z: pd.Series) -> pd.Series:
    return _nullable(lambda v: np.minimum(1.0, 2.0 * norm_sf(np.abs(v))))(z)


@F.pandas_udf(DoubleType())
def power_udf(d: pd.Series, n1: pd.Series, n2: pd.Series, alpha: pd.Series) -> pd.Series:
    return _nullable(power_t)(d, n1, n2, alpha)


@F.pandas_udf(DoubleType())
def min_detectable_udf(n1: pd.Series, n2: pd.Series, alpha: pd.Series, target: pd.Series) -> pd.Series:
    def solve(a, b, al, tg):
        lo, hi = np.zeros(len(a)), np.full(len(a), 10.0)
        crit = t_ppf(1 - al / 2, a + b - 2)
        for _ in range(60):
            mid = (lo + hi) / 2
            weak = _power_at(mid * np.sqrt(a * b / (a + b)), a + b - 2, crit) < tg
            lo, hi = np.where(weak, mid, lo), np.where(weak, hi, mid)
        return (lo + hi) / 2

    return _nullable(solve)(n1, n2, alpha, target)
