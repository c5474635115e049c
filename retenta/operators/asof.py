"""As-of join: to each row the latest earlier row of another table with the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import RANGE, dealt, in_range, with_earlier
from .staging import Stage


def as_of_previous(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: Sequence[str], columns: dict[str, str], stage: Stage,
    same_time: bool = False,
) -> DataFrame:
    """``left`` with ``columns`` (right name to new name) of the last right row of its key before it; NULL if there is none.

    Both tables call the key ``key``. Right rows at the same time come in order of the columns ``tie``, which should tell
    them apart; they count as before the left row only with ``same_time``. A NULL key or time matches nothing, all left rows stay.

    Both sides are put in one order and dealt by ranges of (key, time), so a key with any share of the rows is spread over
    ranges. Each row takes the last right row in its range, else the last one of its key in an earlier range. Nothing
    is multiplied: no row meets more than one other.
    """
    order = ["_time", "_side", "_tie"]
    given = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    known = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    theirs = known.select(
        F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0 if same_time else 1).alias("_side"), F.struct(*tie).alias("_tie"),
        given.alias("_given"))
    ours = left.select(
        F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1 if same_time else 0).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    rows = dealt(ours.unionByName(theirs, allowMissingColumns=True), ["_key"], order, stage)
    # Of the right rows only: max_by leaves out rows whose order is NULL.
    last = F.max_by("_given", F.when(F.col("_given").isNotNull(), F.struct(*order)))
    per_range = rows.groupBy("_key", RANGE).agg(last.alias("_last"))
    found = rows.withColumn("_own", F.last("_given", ignorenulls=True).over(in_range(["_key"], order)))
    found = with_earlier(found, per_range, ["_key"], {"_carried": F.last("_last", ignorenulls=True)})
    mine = found.filter(F.col("_row").isNotNull()).withColumn("_match", F.coalesce("_own", "_carried"))
    return mine.select("_row.*", *[F.col(f"_match.{n}").alias(n) for n in columns.values()])
