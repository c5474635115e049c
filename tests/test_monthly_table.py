"""Tables stored by months: a period reads its own months' files, in order of the date, and gives the rows of a plain filter."""

import random
from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from retenta import Period
from retenta.sources import TABLES, MonthlyTable

from test_plans import plan


def some_gifts(n, seed=1):
    rng = random.Random(seed)
    days = [None, date(2025, 1, 31), date(2025, 2, 1), *(date(2024, 11, 20) + timedelta(i) for i in range(120))]
    return [{"tran_uid": f"t{i}", "donor_no": rng.randrange(9), "tran_amount": Decimal(5), "send_date": rng.choice(days)} for i in range(n)]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def stored(spark, tmp_path):
    return MonthlyTable(spark, str(tmp_path / "gifts"), TABLES["transactions"], "send_date")


def test_a_period_gives_the_rows_of_a_plain_filter(table, stored):
    gifts = table("transactions", *some_gifts(400))
    stored.build(gifts)
    assert rows(stored.rows()) == rows(gifts)
    inside = Period(date(2025, 1, 10), date(2025, 2, 2), "days")
    for period in (inside, Period.month(2025, 1), Period.year(2024), Period.quarter(2026, 1)):
        assert rows(stored.during(period)) == rows(gifts.filter(period.holds(F.col("send_date"))))
    both = stored.during(Period.month(2025, 1), inside)
    assert rows(both) == rows(gifts.filter(Period.month(2025, 1).holds(F.col("send_date")) | inside.holds(F.col("send_date"))))
    assert stored.during().count() == 0


def test_only_the_months_of_a_period_are_read(table, stored):
    stored.build(table("transactions", *some_gifts(400)))
    read = stored.during(Period(date(2025, 1, 10), date(2025, 2, 2), "days"))
    assert "month" in plan(read).split("PartitionFilters: [")[1].split("]")[0]
    seen = {r.f.split("month=")[1][:7] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert seen == {"2025-01", "2025-02"}


def test_rows_are_in_order_of_the_date_in_every_file(table, stored):
    stored.build(table("transactions", *some_gifts(400)))
    files = [f for f in Path(stored.path).rglob("*.parquet") if "undated" not in str(f)]
    assert files
    for f in files:
        days = pq.ParquetFile(f).read(columns=["send_date"]).column("send_date").to_pylist()
        assert days == sorted(days)


def test_late_corrected_and_removed_gifts(table, stored):
    first = some_gifts(300)
    stored.build(table("transactions", *first))
    gone = [g for g in first if not (g["send_date"] and (g["send_date"].year, g["send_date"].month) == (2024, 12))]
    now = [*gone, {"tran_uid": "late", "send_date": date(2025, 1, 2)}, {"tran_uid": "new", "send_date": date(2026, 5, 31)}, {"tran_uid": "bare"}]
    changed = [Period.month(2024, 12), Period.month(2025, 1), Period.month(2026, 5)]
    for _ in range(2):
        stored.refresh(table("transactions", *now), changed)
        assert rows(stored.rows()) == rows(table("transactions", *now))
    assert stored.during(Period.month(2024, 12)).count() == 0


def test_nothing(table, stored):
    stored.build(table("transactions"))
    assert stored.rows().count() == stored.during(Period.month(2025, 1)).count() == 0
    with pytest.raises(ValueError, match="month"):
        MonthlyTable(stored.spark, stored.path, StructType([StructField("month", DateType())]), "month")
