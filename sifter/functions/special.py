"""Special functions as vectorised pandas UDFs.

Spark SQL has no incomplete beta (nor lgamma), so p-values of t and F
statistics use one Arrow-batched UDF.  Inputs are the small per-feature
statistics tables, never experiment rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _betacf(a, b, x, iters=3000, eps=1e-15):
    """Continued fraction of the incomplete beta (modified Lentz), vectorised."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    done = np.zeros(x.shape, dtype=bool)
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = np.where(done, h, h * d * c)
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = np.where(done, h, h * delta)
        done |= np.abs(delta - 1.0) < eps
        if done.all():
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for arrays (NaN where undefined)."""
    a = np.asarray(a, dtype=float)
    b = np.asarray(b, dtype=float)
    x = np.asarray(x, dtype=float)
    a, b, x = np.broadcast_arrays(a, b, x)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbeta = (_lgamma(am + bm) - _lgamma(am) - _lgamma(bm)).astype(float)
        front = np.exp(lbeta + am * np.log(xm) + bm * np.log1p(-xm))
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        flip = ~direct
        if flip.any():
            res[flip] = 1.0 - front[flip] * _betacf(bm[flip], am[flip], 1.0 - xm[flip]) / bm[flip]
        out[mid] = np.clip(res, 0.0, 1.0)
    return out


def t_test_p(r, n) -> np.ndarray:
    """Two-sided p of a correlation r from n pairs (t with n-2 df)."""
    r = np.asarray(r, dtype=float)
    n = np.asarray(n, dtype=float)
    df = n - 2.0
    x = np.clip(1.0 - r * r, 0.0, 1.0)
    p = betainc(df / 2.0, 0.5, x)
    p = np.where(df > 0, p, np.nan)
    return np.where(np.isnan(r), np.nan, p)


def f_test_p(f, df_between, df_within) -> np.ndarray:
    """Upper tail of the F distribution."""
    f = np.asarray(f, dtype=float)
    d1 = np.asarray(df_between, dtype=float)
    d2 = np.asarray(df_within, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
    p = betainc(d2 / 2.0, d1 / 2.0, x)
    return np.where(np.isnan(f) | (d1 <= 0) | (d2 <= 0), np.nan, p)


@F.pandas_udf(T.DoubleType())
def _corr_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(t_test_p(r.to_numpy(dtype=float, na_value=np.nan),
                              n.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def _f_p_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_test_p(f.to_numpy(dtype=float, na_value=np.nan),
                              d1.to_numpy(dtype=float, na_value=np.nan),
                              d2.to_numpy(dtype=float, na_value=np.nan)))


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def corr_p(r: Column, n: Column) -> Column:
    """p-value column of correlation r over n pairs (NULL where undefined)."""
    return _nan_to_null(_corr_p_udf(r.cast("double"), n.cast("double")))


def anova_p(f: Column, df_between: Column, df_within: Column) -> Column:
    return _nan_to_null(_f_p_udf(f.cast("double"), df_between.cast("double"),
                                 df_within.cast("double")))


# --- normal distribution as JVM expressions (used by expected improvement) ---

_SQRT2 = math.sqrt(2.0)
_INV_SQRT2PI = 1.0 / math.sqrt(2.0 * math.pi)


def norm_pdf(z: Column) -> Column:
    return F.lit(_INV_SQRT2PI) * F.exp(-0.5 * z * z)


def norm_cdf(z: Column) -> Column:
    return 0.5 * F.erfc(-z / F.lit(_SQRT2)) if hasattr(F, "erfc") else 0.5 * (1 + _erf(z / F.lit(_SQRT2)))


def _erf(x: Column) -> Column:
    # Abramowitz & Stegun 7.1.26 (|error| < 1.5e-7)
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    y = 1.0 - poly * F.exp(-x * x)
    return F.signum(x) * y
