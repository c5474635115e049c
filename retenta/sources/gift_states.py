"""Stored first and last gifts per pledge, so that a refresh of the commitment view reads the gifts of a few months only.

The states of the gifts of each month are stored, and those of each year. A month
whose gifts have come, have come late or were corrected is worked out anew from its own gifts; its year is merged anew from
twelve months' states; all years are merged when the state is read. As merging is associative, the result is that of
all gifts. First and last gift could not be taken back out of one running state, so a correction needs the months.
Gifts without a date are a month and a year of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..period import Period
from ..plans.commitments import gift_state, merged
from .sinks import replace_folder, replace_folders

MONTH, YEAR, UNDATED = "gift_month", "gift_year", "undated"
LEVEL, LABEL = "_level", "_label"


def _month_of(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))


def _compact(states: DataFrame) -> DataFrame:
    """States as they are stored: a last gift that is the first one too, as in most months, is left out."""
    return states.withColumn("last_gift", F.when(~F.col("last_gift").eqNullSafe(F.col("first_gift")), F.col("last_gift")))


def _whole(stored: DataFrame) -> DataFrame:
    return stored.withColumn("last_gift", F.coalesce("last_gift", "first_gift"))


class GiftStates:
    """The states stored below ``path``: ``months/gift_month=yyyy-MM`` and ``years/gift_year=yyyy``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, transactions: DataFrame) -> None:
        """All months and years from all gifts, by one job.

        The gifts are dealt once, by ranges of year and pledge: what a month or a year holds of a pledge lies in one range, and
        a range meets few months. Both levels are added up there, and the plan has them share the one shuffle.
        """
        day = F.col("send_date")
        year = F.when(day.isNull(), UNDATED).otherwise(F.substring(_month_of(day), 1, 4))
        given = transactions.filter(F.col("pledge_uid").isNotNull()).select("pledge_uid", "send_date", "tran_uid", "tran_amount", year.alias(YEAR))
        dealt = given.repartitionByRange(YEAR, "pledge_uid")
        months = gift_state(dealt.withColumn(MONTH, _month_of(day)), YEAR, MONTH).withColumnRenamed(MONTH, LABEL).drop(YEAR)
        years = gift_state(dealt, YEAR).withColumnRenamed(YEAR, LABEL)
        both = _compact(months).withColumn(LEVEL, F.lit("months")).unionByName(_compact(years).withColumn(LEVEL, F.lit("years")))
        replace_folders(both, self.path, LEVEL, LABEL, {"months": MONTH, "years": YEAR})

    def refresh(self, transactions: DataFrame, months: Sequence[Period], undated: bool = True) -> None:
        """Work out ``months`` anew from their gifts as they are now, and the years they lie in.

        Name every month that gifts came to or went from. ``undated``: whether the gifts without a date are looked at too.
        """
        dates = {m.label: m.holds(F.col("send_date")) for m in months} | ({UNDATED: F.col("send_date").isNull()} if undated else {})
        for label, condition in dates.items():
            replace_folder(_compact(gift_state(transactions.filter(condition))), f"{self.path}/months/{MONTH}={label}")
        stored = self._read("months", MONTH, transactions)
        for year in dict.fromkeys(label if label == UNDATED else label[:4] for label in dates):
            of_year = F.col(MONTH) == UNDATED if year == UNDATED else F.col(MONTH).between(f"{year}-01", f"{year}-12")
            replace_folder(_compact(merged(stored.filter(of_year))), f"{self.path}/years/{YEAR}={year}")

    def state(self, transactions: DataFrame) -> DataFrame:
        """The state of all gifts; ``transactions`` gives the types only and is not read."""
        return merged(self._read("years", YEAR, transactions))

    def _read(self, name: str, partition: str, transactions: DataFrame) -> DataFrame:
        schema = StructType([*gift_state(transactions).schema.fields, StructField(partition, StringType())])
        return _whole(self.spark.read.schema(schema).parquet(f"{self.path}/{name}"))
