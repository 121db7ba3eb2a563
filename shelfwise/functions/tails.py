"""Tail probabilities of the normal, t, F and chi-square distributions.

They run on per-segment result rows, not on the fact. Spark SQL has no such
functions, so each is an Arrow-batched scalar function over numpy arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _nudge(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < _TINY, _TINY, x)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 / _nudge(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for term in (even, odd):
            d = 1.0 / _nudge(1.0 + term * d)
            c = _nudge(1.0 + term / c)
            step = d * c
            out = out * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function I_x(a, b) for 0 <= x <= 1."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inside = np.clip(x, _TINY, 1.0 - 1e-16)
    front = np.exp(
        _log_gamma(a + b)
        - _log_gamma(a)
        - _log_gamma(b)
        + a * np.log(inside)
        + b * np.log1p(-inside)
    )
    flip = inside > (a + 1.0) / (a + b + 2.0)
    first, second = np.where(flip, b, a), np.where(flip, a, b)
    at = np.where(flip, 1.0 - inside, inside)
    part = front * _beta_fraction(first, second, at) / first
    value = np.where(flip, 1.0 - part, part)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    at = np.maximum(x, _TINY)
    front = np.exp(-at + a * np.log(at) - _log_gamma(a))
    # Power series, accurate for small x.
    small = np.minimum(at, a + 1.0)
    term = 1.0 / a
    total = term.copy()
    for k in range(1, 2000):
        term = term * small / (a + k)
        total = total + term
        if np.all(np.abs(term) < np.abs(total) * 1e-16):
            break
    # Continued fraction (modified Lentz), accurate for large x.
    large = np.maximum(at, a + 1.0)
    b = large + 1.0 - a
    c = np.full_like(b, 1.0 / _TINY)
    d = 1.0 / _nudge(b)
    fraction = d.copy()
    for k in range(1, 2000):
        term_k = -k * (k - a)
        b = b + 2.0
        d = 1.0 / _nudge(term_k * d + b)
        c = _nudge(b + term_k / c)
        step = d * c
        fraction = fraction * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    value = np.where(at < a + 1.0, 1.0 - front * total, front * fraction)
    return np.where(x <= 0.0, 1.0, value)


def _t_tail(t: pd.Series, freedom: pd.Series) -> pd.Series:
    t_, v = t.to_numpy(float), freedom.to_numpy(float)
    ok = np.isfinite(v) & ~np.isnan(t_) & (v > 0)
    v_, x_ = np.where(ok, v, 1.0), np.where(ok, t_, 0.0)
    p = incomplete_beta(v_ / 2.0, np.full_like(v_, 0.5), v_ / (v_ + x_ * x_))
    return pd.Series(np.where(ok, p, np.nan)).astype(object).where(ok, None)


def _normal_tail(z: pd.Series) -> pd.Series:
    z_ = z.to_numpy(float)
    ok = ~np.isnan(z_)
    p = np.minimum(_erfc(np.where(ok, z_, 0.0) / math.sqrt(2.0)), 1.0)
    return pd.Series(p).astype(object).where(ok, None)


def _chi_square_tail(x: pd.Series, k: pd.Series) -> pd.Series:
    x_, k_ = x.to_numpy(float), k.to_numpy(float)
    ok = ~np.isnan(x_) & ~np.isnan(k_) & (k_ > 0)
    p = upper_gamma(np.where(ok, k_, 1.0) / 2.0, np.where(ok, x_, 0.0) / 2.0)
    return pd.Series(p).astype(object).where(ok, None)


def _f_tail(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    x_, a, b = x.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    ok = ~np.isnan(x_) & ~np.isnan(a) & ~np.isnan(b) & (a > 0) & (b > 0)
    x_, a, b = np.where(ok, x_, 0.0), np.where(ok, a, 1.0), np.where(ok, b, 1.0)
    p = incomplete_beta(b / 2.0, a / 2.0, b / (b + a * np.maximum(x_, 0.0)))
    return pd.Series(p).astype(object).where(ok, None)


def t_two_sided(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return F.pandas_udf(_t_tail, "double")(t, freedom)


def normal_two_sided_upper(z: Column) -> Column:
    """Twice the upper normal tail at ``z``, at most 1."""
    return F.pandas_udf(_normal_tail, "double")(z)


def chi_square_upper(x: Column, freedom: Column) -> Column:
    return F.pandas_udf(_chi_square_tail, "double")(x, freedom)


def f_upper(x: Column, freedom_1: Column, freedom_2: Column) -> Column:
    return F.pandas_udf(_f_tail, "double")(x, freedom_1, freedom_2)
