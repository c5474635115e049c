"""Tables stored by the month of one of their dates, so that a period is read from its own months' files only.

A month is a folder ``month=yyyy-MM``; rows without a date have one of their own. Its rows are in the order of the date in
every file, so that a range of days skips row groups too. A month of many rows is spread over several files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..period import Period
from .catalog import conform
from .sinks import replace_folder

MONTH, UNDATED = "month", "undated"


def month_of(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))


class MonthlyTable:
    """The table of ``schema`` stored below ``path`` by the month of its column ``day`` (a DATE or TIMESTAMP)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, day: str):
        if MONTH in schema.fieldNames():
            raise ValueError(f"the table has a column {MONTH} of its own")
        self.spark, self.path, self.schema, self.day = spark, path.rstrip("/"), schema, day

    def build(self, rows: DataFrame) -> None:
        """Store the whole table anew."""
        by_month = conform(rows, self.schema).withColumn(MONTH, month_of(F.col(self.day))).hint("rebalance", MONTH)
        replace_folder(by_month.sortWithinPartitions(MONTH, self.day), self.path, MONTH)

    def refresh(self, rows: DataFrame, months: Sequence[Period], undated: bool = True) -> None:
        """Store ``months``, and the rows without a date if ``undated``, as they are in ``rows`` now; the others stay as they are.

        A month that has no rows any more is left as an empty folder. A run that is repeated leaves its months once.
        """
        table, day = conform(rows, self.schema), F.col(self.day)
        for label, wanted in {m.label: m.holds(day) for m in months}.items():
            replace_folder(table.filter(wanted).hint("rebalance").sortWithinPartitions(self.day), f"{self.path}/{MONTH}={label}")
        if undated:
            replace_folder(table.filter(day.isNull()), f"{self.path}/{MONTH}={UNDATED}")

    def rows(self) -> DataFrame:
        """The whole table."""
        return self._stored().drop(MONTH)

    def during(self, *periods: Period) -> DataFrame:
        """The rows of any of the periods, each once; only the files of the months they touch are read."""
        wanted = F.lit(False)
        for period in periods:
            first, last = (d.strftime("%Y-%m") for d in (period.start, period.last_day))
            wanted = wanted | (F.col(MONTH).between(first, last) & period.holds(F.col(self.day)))
        return self._stored().filter(wanted).drop(MONTH)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(MONTH, StringType())])).parquet(self.path)
