"""Tail probabilities as Columns, without a statistics package."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z)."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore")


def chi_square_tail_even(x: Column, df: int) -> Column:
    """P(X >= x) for an even number of degrees of freedom, in closed form."""
    half = x / 2
    total, factorial = F.lit(1.0), 1
    for k in range(1, df // 2):
        factorial *= k
        total = total + F.pow(half, F.lit(k)) / factorial
    return F.exp(-half) * total


def _chi_square(x: float, df: int) -> float:
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return math.exp(-x / 2) * total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, df // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return total


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) for any whole number of degrees of freedom."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else _chi_square(float(a), int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")


def signed_rank_exact(statistic: float, n: int) -> float:
    """P(T >= statistic) for the sum of positive ranks 1..n without ties."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return sum(ways[max(0, math.ceil(statistic)) :]) / 2**n


@F.pandas_udf(T.DoubleType())
def signed_rank_tail(statistic: pd.Series, n: pd.Series) -> pd.Series:
    """``signed_rank_exact`` by row."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else signed_rank_exact(float(a), int(b)) for a, b in zip(statistic, n, strict=True)], dtype="float64")
