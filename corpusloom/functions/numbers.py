"""Percentages, intervals and agreement statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


def percent_value(count: float | None, whole: float | None) -> float | None:
    """Percent to one decimal (ties by the binary value); a share that would show as 0.0 keeps all its digits."""
    if count is None or whole is None or whole <= 0:
        return None
    exact = 100.0 * count / whole
    shown = round(exact, 1)
    return exact if exact and not shown else shown


@F.pandas_udf(T.DoubleType())
def percent(count: pd.Series, whole: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(c) or pd.isna(w) else percent_value(c, w) for c, w in zip(count, whole)], dtype="float64")


def share(count: Column, whole: Column) -> Column:
    """Percent without rounding; null for an empty whole."""
    return F.when(whole > 0, 100.0 * count / whole)


def shown_percent(count: Column, whole: Column) -> Column:
    """Text: ``<0.1%`` for a positive share below 0.1, else the percentage."""
    return F.when((whole > 0) & (count > 0) & (100.0 * count / whole < 0.1), F.lit("<0.1%")).otherwise(percent(count.cast("double"), whole.cast("double")).cast("string"))


def wilson(count: Column, n: Column, z: float = Z95) -> Column:
    """Struct (lower, upper) of the score interval; null for n = 0."""
    p = count / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(((middle - half) / (1 + z * z / n)).alias("lower"), ((middle + half) / (1 + z * z / n)).alias("upper")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most k successes, term by term from logarithms."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def _solve(f: Callable[[float], bool]) -> float:
    """Where f turns from true to false between 0 and 1."""
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact two-sided interval of a binomial proportion."""
    if not 0 <= k <= n or not n or not 0 < alpha < 1:
        raise ValueError("0 <= successes <= total, total > 0 and 0 < alpha < 1 are needed")
    lower = _solve(lambda p: 1 - binomial_tail(k - 1, n, p) < alpha / 2) if k else 0.0
    upper = _solve(lambda p: binomial_tail(k, n, p) > alpha / 2) if k < n else 1.0
    return lower, upper


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def exact_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Columns lower and upper; null where n = 0."""
    got = [clopper_pearson(int(a), int(b)) if b and b > 0 else (None, None) for a, b in zip(k, n)]
    return pd.DataFrame(got, columns=["lower", "upper"], dtype="float64")


def kappa(matrix: np.ndarray) -> tuple[float, float | None]:
    """Raw agreement and Cohen's kappa of a confusion matrix; kappa is None where chance agreement is certain."""
    n = matrix.sum()
    raw = float(np.trace(matrix) / n)
    chance = float(matrix.sum(0) @ matrix.sum(1)) / float(n) ** 2
    return raw, None if abs(1 - chance) < 1e-15 else (raw - chance) / (1 - chance)


def _interval(tables: np.ndarray, undefined: int = 0) -> tuple[np.ndarray, int]:
    n = tables.sum((1, 2)).astype(float)
    raw = np.trace(tables, axis1=1, axis2=2) / n
    chance = (tables.sum(1) * tables.sum(2)).sum(1) / n**2
    ok = np.abs(1 - chance) >= 1e-15
    return (raw[ok] - chance[ok]) / (1 - chance[ok]), undefined + int((~ok).sum())


def percentile_interval(values: np.ndarray, undefined: int, replicates: int) -> tuple[float, float] | None:
    """2.5 and 97.5 percentiles; withheld where over 5 % of the replicates are undefined."""
    if undefined > 0.05 * replicates or not len(values):
        return None
    lo, hi = np.percentile(values, [2.5, 97.5])
    return float(lo), float(hi)


def multinomial_bootstrap(matrix: np.ndarray, replicates: int = 10_000, seed: int = 2026081306) -> tuple[float, float] | None:
    """Interval of kappa from tables drawn by their cell probabilities."""
    n, k = int(matrix.sum()), len(matrix)
    drawn = np.random.default_rng(seed).multinomial(n, matrix.reshape(-1) / n, size=replicates).reshape(-1, k, k)
    values, undefined = _interval(drawn)
    return percentile_interval(values, undefined, replicates)


def paired_bootstrap(cells: np.ndarray, k: int, replicates: int = 10_000, seed: int = 2026081306, at_once: int = 100) -> tuple[float, float] | None:
    """Interval of kappa from records drawn with replacement; cells: for each record row * k + column of the table."""
    rng, n = np.random.default_rng(seed), len(cells)
    values, undefined = [], 0
    for at in range(0, replicates, at_once):
        m = min(at_once, replicates - at)
        drawn = cells[rng.integers(0, n, size=(m, n))]
        flat = drawn + np.arange(m)[:, None] * (k * k)
        tables = np.bincount(flat.reshape(-1), minlength=m * k * k).reshape(m, k, k)
        got, undefined = _interval(tables, undefined)
        values.append(got)
    return percentile_interval(np.concatenate(values), undefined, replicates)


def paired_table_bootstrap(matrix: np.ndarray, replicates: int = 10_000, seed: int = 2026081306, at_once: int = 5_000_000) -> tuple[float, float] | None:
    """paired_bootstrap of the records that a table counts, laid out cell by cell, with at most ``at_once`` drawn at a time."""
    rng, k, n = np.random.default_rng(seed), len(matrix), int(matrix.sum())
    ends = np.cumsum(matrix.reshape(-1))
    some = max(1, min(100, at_once // n))
    values, undefined = [], 0
    for at in range(0, replicates, some):
        m = min(some, replicates - at)
        tables = np.zeros((m, k * k), np.int64)
        for done in range(0, n, at_once):
            cells = np.searchsorted(ends, rng.integers(0, n, size=(m, min(at_once, n - done))), "right")
            tables += np.bincount((cells + np.arange(m)[:, None] * (k * k)).reshape(-1), minlength=m * k * k).reshape(m, -1)
        got, undefined = _interval(tables.reshape(m, k, k), undefined)
        values.append(got)
    return percentile_interval(np.concatenate(values), undefined, replicates)
