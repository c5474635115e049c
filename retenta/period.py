"""Reporting periods.

Every job takes its dates from a ``Period``. Filters built from one are half-open ranges on the bare
column, so parquet row groups and date partitions can be skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_of_month(year: int, month_index: int) -> date:
    """First day of the month ``month_index`` months after January of ``year``."""
    return date(year + month_index // 12, month_index % 12 + 1, 1)


@dataclass(frozen=True)
class Period:
    start: date
    end_exclusive: date
    label: str

    @classmethod
    def month(cls, year: int, month: int) -> Period:
        return cls(date(year, month, 1), _first_of_month(year, month), f"{year:04d}-{month:02d}")

    @classmethod
    def quarter(cls, year: int, quarter: int) -> Period:
        first = 3 * (quarter - 1)
        return cls(_first_of_month(year, first), _first_of_month(year, first + 3), f"{year:04d}Q{quarter}")

    @classmethod
    def half(cls, year: int, half: int) -> Period:
        first = 6 * (half - 1)
        return cls(_first_of_month(year, first), _first_of_month(year, first + 6), f"{year:04d}H{half}")

    @classmethod
    def year(cls, year: int) -> Period:
        return cls(date(year, 1, 1), date(year + 1, 1, 1), f"{year:04d}")

    @classmethod
    def ytd(cls, year: int, month: int) -> Period:
        return cls(date(year, 1, 1), _first_of_month(year, month), f"{year:04d} YTD {month:02d}")

    @classmethod
    def trailing(cls, year: int, month: int, months: int = 12, label: str | None = None) -> Period:
        """The ``months`` whole months that end with the given month."""
        start = _first_of_month(year, month - months)
        return cls(start, _first_of_month(year, month), label or f"{months}M to {year:04d}-{month:02d}")

    def months(self) -> list[Period]:
        """The calendar months of a period of whole months."""
        if self.start.day != 1 or self.end_exclusive.day != 1:
            raise ValueError(f"{self.label} does not hold whole months")
        first, last = (12 * day.year + day.month - 1 for day in (self.start, self.end_exclusive))
        return [Period.month(i // 12, i % 12 + 1) for i in range(first, last)]

    @property
    def last_day(self) -> date:
        return self.end_exclusive - timedelta(days=1)

    @property
    def year_number(self) -> int:
        return self.last_day.year

    @property
    def yymm(self) -> str:
        return self.start.strftime("%y%m")

    def shifted(self, days: int) -> Period:
        """The same range moved by whole days (the collector books one day early)."""
        step = timedelta(days=days)
        return Period(self.start + step, self.end_exclusive + step, self.label)

    def holds(self, column: Column) -> Column:
        """True where a DATE (or TIMESTAMP) column falls in the period."""
        return (column >= F.lit(self.start)) & (column < F.lit(self.end_exclusive))

    def holds_text(self, column: Column, fmt: str = "%Y%m%d") -> Column:
        """As ``holds`` for dates stored as sortable text, compared without parsing."""
        return (column >= self.start.strftime(fmt)) & (column < self.end_exclusive.strftime(fmt))
