"""Calendar arithmetic on columns, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(day, "MM")


def month_diff(later: Column, earlier: Column) -> Column:
    """Month boundaries crossed: 31 January to 1 February is 1, whatever the day of the month."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("bigint")


def first_of_month_text(month: Column) -> Column:
    """``yyyy-MM`` text to the DATE of its first day."""
    return F.to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def whole_years_between(later: Column, earlier: Column) -> Column:
    """Whole years by month boundaries, rounded down (also below zero)."""
    return F.floor(month_diff(later, earlier) / F.lit(12)).cast("bigint")
