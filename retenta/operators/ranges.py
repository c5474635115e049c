"""Rows dealt to tasks by ranges of (key, order), and what a key's earlier ranges hold.

A plain window puts all rows of a key into one task. Here a key with many rows spans several ranges. What is asked of a
row's predecessors is answered within its range, and what the key's earlier ranges add to it is one value a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .staging import Stage, as_is

RANGE, SALT = "_range", "_salt"


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], stage: Stage) -> DataFrame:
    """``df`` in ranges of keys, then order, with the range's number; stored, so that all that follows sees the same ranges.

    The salt differs for each row, so that rows equal in keys and order are spread too. NULL is a key like any other.
    Dealing looks at its input twice, so that should be cheap to read.
    """
    if stage is as_is:
        raise ValueError("rows dealt by ranges must be stored: ranges worked out twice may differ")
    salted = df.withColumn(SALT, F.monotonically_increasing_id())
    return stage(salted.repartitionByRange(*keys, *order, SALT).withColumn(RANGE, F.spark_partition_id()))


def in_range(keys: Sequence[str], order: Sequence[Column | str]) -> WindowSpec:
    """The rows of a key in a range, in order."""
    return Window.partitionBy(RANGE, *keys).orderBy(*order, SALT)


def with_earlier(df: DataFrame, per_range: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with ``totals`` over a key's earlier ranges, NULL in its first one.

    ``per_range`` has a row for each key and range; ``totals`` are aggregates of its columns, over ranges in order. A range
    starts within one key at most, so only as many rows as there are ranges are joined, which is why they may be broadcast.
    """
    by_range = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(RANGE)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    sums = per_range.select(*keys, RANGE, F.row_number().over(by_range).alias("_nth"), *[c.over(before).alias(n) for n, c in totals.items()])
    later = sums.filter(F.col("_nth") > 1).select(F.col(RANGE).alias("_in"), *[F.col(k).alias(f"_of_{k}") for k in keys], *totals)
    same = F.col(RANGE) == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return df.join(F.broadcast(later), same, "left").drop("_in", *[f"_of_{k}" for k in keys])
