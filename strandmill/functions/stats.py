"""Tail probabilities and collision bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_RATE = 0.001


def _tail(m: np.ndarray, trials: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= m) of binomial X, by summing terms upwards from m until they vanish: no cancellation for tiny tails."""
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    out = np.zeros(len(m))
    sure = m <= 0
    out[sure] = 1.0
    live = ~sure & (m <= trials) & (p > 0)
    if live.any():
        n, k, q = trials[live].astype(float), m[live].astype(float), p[live]
        first = (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)).astype(float) + k * np.log(q) + (n - k) * np.log1p(-q)
        term, total = np.exp(first), np.exp(first)
        while True:
            term = term * np.maximum(n - k, 0) / (k + 1) * q / (1 - q)
            k = k + 1
            total = total + term
            if not (term > total * 1e-17).any():
                break
        out[live] = np.minimum(total, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _binom_tail(length: pd.Series, neighbour: pd.Series, distance: pd.Series, count: pd.Series) -> pd.Series:
    error = ERROR_RATE
    p = error**distance * (1 - error) ** (length - distance)
    tail = _tail(count.to_numpy(), (count + neighbour).to_numpy(), p.to_numpy())
    return pd.Series(np.where(neighbour.to_numpy() == 0, 0.0, tail))


def noise_probability(length: Column, neighbour: Column, distance: Column, count: Column) -> Column:
    """Chance that `count` or more of count + neighbour reads come from a neighbour at `distance` by errors; 0 without neighbour."""
    return _binom_tail(*(c.cast("double") for c in (length, neighbour, distance, count)))


def noise_probability_any(length: Column, neighbour: Column, distance: Column, count: Column) -> Column:
    """The same for any of the C(length, distance) ways to be wrong: 1 - (1 - tail) ** C, without cancellation."""
    single = noise_probability(length, neighbour, distance, count)
    ways = F.round(F.exp(_lchoose(length, distance)), 0)
    return F.when(neighbour == 0, 0.0).otherwise(-F.expm1(ways * F.log1p(-F.least(single, F.lit(1.0)))))


@F.pandas_udf(T.DoubleType())
def _lchoose_udf(n: pd.Series, k: pd.Series) -> pd.Series:
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    return pd.Series((lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)).astype(float))


def _lchoose(n: Column, k: Column) -> Column:
    return _lchoose_udf(n.cast("double"), k.cast("double"))


def collision_bound(n: int, length: int, letters: int, cutoff: int) -> float:
    """Upper bound of the chance that two of n distinct random strings lie within the cutoff; can fall below 0."""
    near = sum(math.comb(length, k) * (1 / letters) ** (length - k) * (1 - 1 / letters) ** k for k in range(cutoff + 1))
    whole = float(letters) ** length
    distinct = math.exp(sum(math.log(whole - i) for i in range(n)) - n * math.log(whole))
    return 1 - (1 - near) ** (n * (n - 1) // 2) / distinct


def _sum_log_distinct(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sum of log(1 - i / whole) over i from 0 to n - 1, for n <= whole: by lgamma where n is a good part of whole, else by Euler and Maclaurin, as lgamma would cancel."""
    x = n / whole
    k = np.arange(1.0, 11.0)
    out = -n * (x[:, None] ** k / (k * (k + 1))).sum(1) - np.log1p(-np.minimum(x, 0.5)) / 2 - x / (12 * np.maximum(whole - n, 1))
    large = x >= 0.01
    if large.any():
        lgamma = np.frompyfunc(math.lgamma, 1, 1)
        m, w = n[large], whole[large]
        out[large] = (lgamma(w + 1) - lgamma(w - m + 1)).astype(float) - m * np.log(w)
    return out


@F.pandas_udf(T.DoubleType())
def _log_distinct(n: pd.Series, whole: pd.Series) -> pd.Series:
    n, whole = n.to_numpy(dtype=float), whole.to_numpy(dtype=float)
    return pd.Series(_sum_log_distinct(np.minimum(n, whole), whole))


def collision_bounds(n: Column, length: Column, letters: int, cutoff: int) -> Column:
    """The same as a column, for any number of strings; computed in logarithms.

    Fewer than two strings can't collide: 0. Strings no longer than the cutoff always do, and of more strings than there are
    possible ones two must be the same: 1.
    """
    n, length = n.cast("double"), length.cast("double")
    whole = F.pow(F.lit(float(letters)), length)
    near, ways = F.lit(0.0), F.lit(1.0)
    for k in range(cutoff + 1):
        near = near + ways * F.pow(F.lit(1 / letters), length - k) * F.pow(F.lit(1 - 1 / letters), F.lit(float(k)))
        ways = ways * (length - k) / (k + 1)
    bound = -F.expm1(n * (n - 1) / 2 * F.log1p(-near) - _log_distinct(n, whole))
    return F.when(n < 2, 0.0).when((length <= cutoff) | (n > whole), 1.0).otherwise(bound)
