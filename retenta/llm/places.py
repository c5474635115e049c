"""Places of rows in an order, over the whole table or within keys, without a task that holds a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], space: Workspace, name: str) -> DataFrame:
    """``df`` written in ranges of keys, then order, with ``part`` (the range) and ``salt``.

    The salt is another for each row, so that equal rows, however many, are spread over ranges too.
    """
    salted = df.withColumn("salt", F.monotonically_increasing_id())
    return space.stage(salted.repartitionByRange(*keys, *order, "salt").withColumn("part", F.spark_partition_id()), name)


def earlier(per_part: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """What the earlier ranges of a key add up to: keys, part and ``totals``, for the parts of a key but its first.

    ``per_part`` has a row for each key and part. A key that has an earlier part has begun before this one, so there is
    one such key in a part at most: no more rows than there are ranges, which may be broadcast.
    """
    window = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("part")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    found = per_part.select(*keys, "part", F.row_number().over(window).alias("nth"), *[c.over(before).alias(n) for n, c in totals.items()])
    found = found.where("nth > 1").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("part").alias("of_part"), *totals)
    return F.broadcast(found)


def with_earlier(df: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``earlier``, null where there is nothing earlier."""
    same = F.col("part") == F.col("of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return df.join(sums, same, "left").drop("of_part", *[f"of_{k}" for k in keys])


def within(keys: Sequence[str], order: Sequence[Column | str]):
    """The window over the rows of a key in a part, in order."""
    return Window.partitionBy("part", *keys).orderBy(*order, "salt")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], space: Workspace, name: str, number: str) -> DataFrame:
    """``df`` with the place of each row in its key (from 1) as ``number``, and ``part`` and ``salt``; null is a key like any other.

    Rows that are equal in keys and order are numbered in any way.
    """
    rows = dealt(df, keys, order, space, name)
    sums = earlier(rows.groupBy(*keys, "part").agg(F.count("*").alias("c")), keys, {"skip": F.sum("c")})
    placed = with_earlier(rows.withColumn("i", F.row_number().over(within(keys, order))), sums, keys)
    return placed.withColumn(number, (F.col("i") + F.coalesce("skip", F.lit(0))).cast("long")).drop("i", "skip")
