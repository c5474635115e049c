"""Checks on inputs and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A lookup names one key more than once."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys (without NULLs, which never join) that appear more than once, with their row count."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1)
    )


def require_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The same frame, or DuplicateKeys if a key repeats (runs one job)."""
    if not duplicate_keys(df, keys).isEmpty():
        raise DuplicateKeys(f"{name}: {list(keys)} is not unique")
    return df


def split_outliers(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): a row is removed if all columns of one rule equal its values; NULL never equals."""
    matches = [reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in rule.items()]) for rule in rules]
    known_bad = F.coalesce(reduce(lambda a, b: a | b, matches), F.lit(False))
    return df.filter(~known_bad), df.filter(known_bad)
