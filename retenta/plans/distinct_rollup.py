"""Exact numbers of distinct one-off donors of any period and section, from stored bitmaps.

Distinct counts of months don't add up to that of their quarter, as a donor may give in each. A set of donors does: a bit
for each donor number, in bitmaps of as many numbers as Spark's bitmap functions hold in one. The bitmaps of a month and
section are stored once; those of a longer period are their union, and its count is the number of bits set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import month_start
from ..period import Period
from ..sources.sinks import append_period, read_report
from .monthly import oneoff_gifts



def donor_bitmaps(transactions: DataFrame, span: Period) -> DataFrame:
    """The one-off donors of each month of ``span`` and section as bitmaps: month, donation_section, bucket, donors.

    A gift without a donor number counts for no donor. Bits are set before the shuffle, so a section with most of the gifts
    sends a bitmap a task and bucket.
    """
    donor = F.col("donor_no")
    return (
        oneoff_gifts(transactions, span).filter(donor.isNotNull())
        .groupBy(month_start(F.col("send_date")).alias("month"), "donation_section", F.bitmap_bucket_number(donor).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(donor)).alias("donors"))
    )


def levels(month: Column) -> dict[str, Column]:
    """The label of the month, quarter, half and year that a month lies in."""
    year = F.date_format(month, "yyyy")
    return {
        "month": F.date_format(month, "yyyy-MM"), "quarter": F.concat(year, F.lit("Q"), F.quarter(month)),
        "half": F.concat(year, F.lit("H"), F.ceil(F.quarter(month) / 2)), "year": year,
    }


def oneoff_rollup(bitmaps: DataFrame) -> DataFrame:
    """Distinct one-off donors by month, quarter, half and year: level, period, scope, donation_section, oo_donor.

    ``scope`` is "section" for the rows of a section (also of the one without a name) and "all" for the donors of all
    sections, who count once. Gifts are not read.
    """
    def rows(level: str, label: Column, scope: str, section: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), label.alias("period"), F.lit(scope).alias("scope"), section.alias("donation_section"))

    scopes = {"section": F.col("donation_section"), "all": F.lit(None).cast("string")}
    every = F.array(*[rows(level, label, scope, section) for level, label in levels(F.col("month")).items() for scope, section in scopes.items()])
    named = bitmaps.select("bucket", "donors", F.explode(every).alias("at")).select("at.*", "bucket", "donors")
    keys = ["level", "period", "scope", "donation_section"]
    unions = named.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("donors").alias("donors"))
    return unions.groupBy(*keys).agg(F.sum(F.bitmap_count("donors")).alias("oo_donor"))


def store_bitmaps(transactions: DataFrame, month: Period, path: str) -> None:
    """Replace the stored bitmaps of one month; only its gifts are read."""
    found = donor_bitmaps(transactions, month)
    append_period(found, found.schema, path, month.label)


def stored_bitmaps(transactions: DataFrame, path: str, span: Period) -> DataFrame:
    """The stored bitmaps of the months of ``span``; ``transactions`` gives the types only."""
    stored = read_report(transactions.sparkSession, donor_bitmaps(transactions, span).schema, path)
    wanted = reduce(lambda a, b: a | b, [F.col("report_period") == m.label for m in span.months()])
    return stored.filter(wanted).drop("report_period")
