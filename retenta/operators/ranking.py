"""First row per key and row numbers within a key, safe for keys that hold much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE, dealt, in_range, with_earlier
from .staging import Stage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` lets the planner keep one row per key in every input partition before the
    shuffle, so a key with a third of the rows still sends one row per task. End ``order`` with a unique
    column, or ties are settled at random.
    """
    spot = "_place"
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(spot, F.row_number().over(window)).filter(F.col(spot) == 1).drop(spot)


def ordinal(df: DataFrame, key: str, coarse: Sequence[str], tie: str, name: str, stage: Stage) -> DataFrame:
    """Number the rows of each key by ``coarse`` columns, then the unique ``tie``, from 1. NULL keys are one key.

    A plain window would sort all rows of one key in one task. Here only key, order and id are dealt by ranges, and
    numbered within (range, key); the numbers of the key's earlier ranges are added, and the number meets its row by the
    id. ``stage`` stores these few columns, before and after they are dealt; the rows themselves are worked out once more,
    which must give the same ids.
    """
    order = [*coarse, tie]
    ids = dealt(stage(df.select(key, *order)), [key], order, stage)
    counts = ids.groupBy(key, RANGE).agg(F.count(F.lit(1)).alias("_rows"))
    placed = ids.withColumn("_place", F.row_number().over(in_range([key], order)))
    placed = with_earlier(placed, counts, [key], {"_earlier": F.sum("_rows")})
    number = (F.col("_place") + F.coalesce("_earlier", F.lit(0))).cast("bigint").alias(name)
    return df.join(placed.select(F.col(tie).alias("_tie"), number), F.col(tie).eqNullSafe(F.col("_tie"))).select(*df.columns, name)
