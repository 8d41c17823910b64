"""Special functions in numpy: incomplete beta, Student's t, normal, digamma and trigamma."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

_gammaln = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_gammaln(a + b) - _gammaln(a) - _gammaln(b) + a * np.log(x) + b * np.log1p(-x))
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        value = front * _fraction(p, q, y) / p
    out = np.where(swap, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) of Student's t; the normal one for infinite degrees of freedom."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    flat = np.isinf(df)
    d = np.where(flat, 1.0, df)
    p = np.where(flat, normal_two_sided(t), betainc(d / 2, np.full_like(d, 0.5), d / (d + t * t)))
    return np.where(np.isnan(t) | np.isnan(df), np.nan, p)


def normal_two_sided(z) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def digamma(x: float) -> float:
    s = 0.0
    while x < 8:
        s -= 1 / x
        x += 1
    y = 1 / (x * x)
    return s + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    s = 0.0
    while x < 8:
        s += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return s + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def inverse_trigamma(v: float) -> float:
    """x with trigamma(x) = v, by bisection in the logarithm."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if trigamma(mid) > v else (low, mid)
    return math.sqrt(low * high)


@F.pandas_udf(DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p), None)


@F.pandas_udf(DoubleType())
def _z_udf(z: pd.Series) -> pd.Series:
    p = normal_two_sided(z.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p), None)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; a batch-wise Python function, for one row per test."""
    return _t_udf(t.cast("double"), df.cast("double"))


def z_p_value(z: Column) -> Column:
    return _z_udf(z.cast("double"))
