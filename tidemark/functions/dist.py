"""Tail probabilities by vectorised incomplete beta and gamma functions, as Arrow UDFs over a few result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def gammainc_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(-x + a * np.log(x) - _lgamma(a))
    term = 1 / a
    total = term.copy()
    for n in range(1, 500):
        term = term * x / (a + n)
        total = total + term
    b = x + 1 - a
    c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for n in range(1, 500):
        an = -n * (n - a)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        h = h * d * c
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def _udf(f):
    """Column function of a numeric one; null where an argument is null, NaN or degrees of freedom run out."""

    @F.pandas_udf("double")
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        x, a, b = (s.to_numpy(dtype=float) for s in (x, a, b))
        ok = np.isfinite(x) & (a > 0) & (b > 0)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = f(x[ok], a[ok], b[ok])
        return pd.Series(out).astype(object).where(ok, None)

    return run


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("double")


def t_pvalue(t, df) -> Column:
    return _udf(lambda t, df, _: t_two_sided(t, df))(_d(t), _d(df), F.lit(1.0))


def f_pvalue(f, d1, d2) -> Column:
    return _udf(lambda x, d1, d2: betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(x, 0))))(_d(f), _d(d1), _d(d2))


def chi2_pvalue(x, df) -> Column:
    return _udf(lambda x, df, _: gammainc_upper(df / 2, np.maximum(x, 0) / 2))(_d(x), _d(df), F.lit(1.0))
