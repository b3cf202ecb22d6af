"""Tail probabilities of test statistics, vectorised over Arrow batches; null where an argument is null or out of range."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LOG_GAMMA = np.vectorize(lambda x: math.lgamma(x) if x > 0 else math.nan, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, terms: int = 300) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (evaluated from the front, both recurrences kept off zero)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_LOG_GAMMA(p + q) - _LOG_GAMMA(p) - _LOG_GAMMA(q) + p * np.log(z) + q * np.log1p(-z)) / p
        off_zero = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
        num, den = np.ones_like(z), 1 / off_zero(1 - (p + q) * z / (p + 1))
        value = den.copy()
        for m in range(1, terms):
            for c in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                den = 1 / off_zero(1 + c * den)
                num = off_zero(1 + c / num)
                value = value * den * num
            if np.all(np.abs(den * num - 1) < 1e-15 + np.isnan(value)):
                break
        out = np.where(z <= 0, 0.0, front * value)
    return np.where(turned, 1 - out, out)


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f)."""
    with np.errstate(all="ignore"):
        return np.where(f < 0, np.nan, incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|)."""
    return f_tail(t * t, np.ones_like(t), df)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(|Z| > |z|)."""
    return _ERFC(np.abs(z) / math.sqrt(2))


#: Ranges of normals beyond REACH have tails below the least float64; steps of the table of their tails, and points of the rule over the scale.
REACH, GRID, POINTS = 52.0, 0.01, 400


@lru_cache(maxsize=64)
def _log_range_tail(groups: int) -> np.ndarray:
    """log P(range of so many normals > w) on a grid of w, computed as a tail: the part of the maximum's density with the minimum farther away.

    The integrand falls off like a Gauss curve on both sides of w / 2, so that the trapezoid rule is exact to rounding.
    """
    w = np.arange(0, REACH + 4 * GRID, GRID)[:, None]
    z = w / 2 + np.linspace(-9, 9, 121)
    below, away = _ERFC(-z / math.sqrt(2)) / 2, _ERFC((w - z) / math.sqrt(2)) / 2
    with np.errstate(divide="ignore"):
        lost = -np.expm1((groups - 1) * np.log1p(-np.minimum(away / below, 1)))
        tail = (groups * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * below ** (groups - 1) * lost).sum(1) * (18 / 120)
        return np.log(np.minimum(tail, 1))


def _interpolated(table: np.ndarray, w: np.ndarray) -> np.ndarray:
    """exp of a table on the grid, by cubics through four neighbours; 0 beyond it."""
    at = np.clip((w / GRID).astype(int), 1, len(table) - 3)
    t = w / GRID - at
    a, b, c, d = (table[at + i] for i in (-1, 0, 1, 2))
    value = b + t * (c - b) + t * (t - 1) / 2 * ((a - 2 * b + c) + (t + 1) / 3 * (d - 3 * c + 3 * b - a))
    return np.where(w < REACH, np.exp(np.minimum(value, 0)), 0.0)


def _log_scale(y: np.ndarray, df: float) -> np.ndarray:
    """log density of y = log of the scale, the root of a chi-square over its df; Stirling's series keeps large df exact."""
    x = df / 2
    shape = df * (y - np.expm1(2 * y) / 2)
    if df < 30:
        return math.log(2) + x * math.log(x) - x - math.lgamma(x) + shape
    return math.log(2) + math.log(x / (2 * math.pi)) / 2 - 1 / (12 * x) + 1 / (360 * x**3) - 1 / (1260 * x**5) + shape


def _range_tail(q: np.ndarray, groups: int, df: float) -> np.ndarray:
    """P(studentised range > q) for one number of groups and one df: a trapezoid rule over the logarithm of the scale, about where a given q's tail comes from."""
    table, root, out = _log_range_tail(groups), math.sqrt(df), np.empty(len(q))
    steps = np.linspace(-40 / df - 9 / root, math.log1p(90 / df) / 2 + 6 / root, POINTS)
    for a in range(0, len(q), 2000):
        y = -np.log1p(q[a : a + 2000, None] ** 2 / (2 * df)) / 2 + steps
        out[a : a + 2000] = (np.exp(_log_scale(y, df)) * _interpolated(table, q[a : a + 2000, None] * np.exp(y))).sum(1) * (steps[1] - steps[0])
    return np.minimum(out, 1.0)


def range_tail(q: np.ndarray, groups: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(studentised range > q), right in the tail too; one table for each number of groups, one rule for each pair of it and df. Null for df below 1, fewer than 2 groups or a negative q."""
    out = np.full(len(q), np.nan)
    good = (q >= 0) & (groups >= 2) & (df >= 1)
    for k, v in np.unique(np.stack([groups[good], df[good]], 1), axis=0):
        at = np.flatnonzero(good & (groups == k) & (df == v))
        out[at] = _range_tail(q[at], int(k), float(v))
    return out


@lru_cache(maxsize=4096)
def _range_quantile(p: float, groups: int, df: float) -> float:
    low, high = 0.0, 1.0
    tail = lambda q: _range_tail(np.array([q]), groups, df)[0]
    while tail(high) > p:
        low, high = high, 2 * high
    while high - low > 1e-13 * high:
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if tail(middle) > p else (low, middle)
    return (low + high) / 2


def range_quantile(p: np.ndarray, groups: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The q that a studentised range exceeds with probability p, 0 < p < 1: bisection between ends that hold it."""
    good = (p > 0) & (p < 1) & (groups >= 2) & (df >= 1)
    return np.array([_range_quantile(float(a), int(k), float(v)) if g else math.nan for a, k, v, g in zip(p, groups, df, good)])


def _vectorised(function):
    def run(*series: pd.Series) -> pd.Series:
        arrays = [s.to_numpy(float, na_value=np.nan) for s in series]
        known = ~np.any([np.isnan(a) for a in arrays], axis=0)
        out = np.full(len(arrays[0]), np.nan)
        if known.any():
            out[known] = function(*(a[known] for a in arrays))
        return pd.Series(out).where(~np.isnan(out), None)

    return run


def _apply(function, *columns: Column) -> Column:
    wrapped, n = _vectorised(function), len(columns)
    if n == 1:
        def udf(a: pd.Series) -> pd.Series:
            return wrapped(a)
    elif n == 2:
        def udf(a: pd.Series, b: pd.Series) -> pd.Series:
            return wrapped(a, b)
    else:
        def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return wrapped(a, b, c)
    return F.pandas_udf(udf, DoubleType())(*(c.cast("double") for c in columns))


def p_from_t(t: Column, df: Column) -> Column:
    return _apply(t_tail, t, df)


def p_from_f(f: Column, d1: Column, d2: Column) -> Column:
    return _apply(f_tail, f, d1, d2)


def p_from_z(z: Column) -> Column:
    return _apply(normal_tail, z)


def p_from_range(q: Column, groups: Column, df: Column) -> Column:
    return _apply(range_tail, q, groups, df)


def range_critical(p: Column, groups: Column, df: Column) -> Column:
    return _apply(range_quantile, p, groups, df)


def normal_below(z: np.ndarray) -> np.ndarray:
    """Probability of a standard normal value of at most z."""
    return _ERFC(-z / math.sqrt(2)) / 2


def normal_cdf(x: Column) -> Column:
    return _apply(normal_below, x)
