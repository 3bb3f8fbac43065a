"""Special functions and small dense algebra that Spark has no built-in for; scalar code for the driver
and for Arrow batches (see the ``*_udf`` columns)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a power series left of a + 1, a continued fraction right of it."""
    if x < 0 or a <= 0:
        raise ValueError("gamma_upper needs a > 0 and x >= 0")
    if x == 0:
        return 1.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        total = term = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(scale))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(scale + math.log(h)) if h > 0 and scale + math.log(h) > -745 else 0.0


def chi_square_tail(x: float | None, df: float | None) -> float | None:
    """P(chi-square with df degrees > x); null without degrees of freedom."""
    if x is None or df is None or df <= 0 or math.isnan(x):
        return None
    return gamma_upper(df / 2, max(0.0, x) / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else math.nan


def inverse_normal(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi_square_tail_udf(x: Column, df: Column) -> Column:
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([chi_square_tail(v, d) for v, d in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(x, df)


def _each(function, x: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield v.map(function)

    return F.pandas_udf(run, "double")(x)


def normal_two_sided_udf(z: Column) -> Column:
    return _each(normal_two_sided, z)


def inverse_normal_udf(p: Column) -> Column:
    return _each(inverse_normal, p)


def solve(matrix: np.ndarray, right: np.ndarray, singular: float = 1e-14) -> np.ndarray:
    """A small system by elimination with row exchange; ValueError where a pivot is under ``singular``."""
    a = np.column_stack([np.asarray(matrix, float), np.asarray(right, float)])
    n = len(a)
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        if abs(a[p, k]) < singular:
            raise ValueError("singular system")
        a[[k, p]] = a[[p, k]]
        a[k] /= a[k, k]
        others = np.arange(n) != k
        a[others] -= np.outer(a[others, k], a[k])
    return a[:, n:].squeeze(1) if np.ndim(right) == 1 else a[:, n:]


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Least-squares slope, intercept and R2; NaN for fewer than two points or no spread."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 2 or (sxx := float(((x - x.mean()) ** 2).sum())) <= 0:
        return math.nan, math.nan, math.nan
    slope = float(((x - x.mean()) * (y - y.mean())).sum()) / sxx
    cut = float(y.mean()) - slope * float(x.mean())
    syy = float(((y - y.mean()) ** 2).sum())
    return slope, cut, 1 - float(((y - cut - slope * x) ** 2).sum()) / syy if syy > 0 else math.nan


def next_power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def levinson(acf: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial autocorrelations, innovation variances for orders 0..order, and the last coefficients.

    The error shrinks by 1 - k^2, by a factor of 1e-12 at the least.
    """
    acf = np.asarray(acf, float)
    pacf, var = np.zeros(order + 1), np.zeros(order + 1)
    pacf[0], var[0] = 1.0, acf[0]
    phi = np.zeros(0)
    if acf[0] <= 0:
        return pacf, var, phi
    for p in range(1, order + 1):
        k = (acf[p] - float(phi @ acf[p - 1 : 0 : -1])) / var[p - 1] if var[p - 1] else 0.0
        phi = np.append(phi - k * phi[::-1], k)
        pacf[p], var[p] = k, var[p - 1] * max(1e-12, 1 - k * k)
    return pacf, var, phi


def autoregression(acf: np.ndarray, order: int) -> np.ndarray:
    """Yule-Walker coefficients of one order."""
    return levinson(np.asarray(acf)[: order + 1], order)[2]


def lag_sums(own: np.ndarray, seen: np.ndarray, max_lag: int) -> np.ndarray:
    """Sums of own[i] * seen[i - lag] at lags 0..max_lag, by a zero-padded transform; both have the same places."""
    size = next_power_of_two(len(seen) + max_lag)
    return np.fft.irfft(np.fft.rfft(own, size) * np.conj(np.fft.rfft(seen, size)), size)[: max_lag + 1]


def acf_fft(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Biased autocorrelation by a zero-padded transform; [1, 0, ...] for a flat series."""
    x = np.asarray(x, float) - np.mean(x)
    c = lag_sums(x, x, max_lag)
    return c / c[0] if c[0] > 0 else np.eye(1, max_lag + 1)[0]


def periodogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequency, period in lags, and power for bins 1 to half of the padded size."""
    x = np.asarray(x, float) - np.mean(x)
    size = next_power_of_two(len(x))
    k = np.arange(1, size // 2 + 1)
    return k / size, size / k, np.abs(np.fft.rfft(x, size)[1:]) ** 2 / len(x)
