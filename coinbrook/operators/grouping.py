"""Group-by with data-frame rules for missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.functions.amounts import money_mean, money_sum


def grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group by keys; rows with a missing key belong to no group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggregates)


def sum_by(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    return grouped(df, keys, money_sum(F.col(amount)).alias(amount))


def mean_by(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    return grouped(df, keys, money_mean(F.col(amount)).alias(amount))
