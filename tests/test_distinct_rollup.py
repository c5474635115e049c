"""Distinct donors from bitmaps against counting the gifts."""

import random
from datetime import date, timedelta

from retenta import Period
from retenta.plans import distinct_rollup as roll

from test_plans import plan

YEAR = Period.year(2025)


def gifts_of(table, rng, n):
    ids = [0, -1, -40_000, 32_768, 32_769, 2 ** 40, *range(1, 30)]
    return [{"tran_uid": str(i), "donor_no": rng.choice([None, *ids]), "send_date": rng.choice([None, date(2024, 12, 20) + timedelta(rng.randrange(400))]),
             "payment_type": rng.choice(["수시", "수시", "정기"]), "pledge_active": rng.choice(["N", "N", "Y"]),
             "donation_section": rng.choice(["a", "a", "b", None])} for i in range(n)]


def brute(gifts):
    found = {}
    for g in gifts:
        day, donor = g["send_date"], g["donor_no"]
        if day and donor is not None and day.year == 2025 and g["payment_type"] == "수시" and g["pledge_active"] == "N":
            q = (day.month + 2) // 3
            for level, period in (("month", f"2025-{day.month:02d}"), ("quarter", f"2025Q{q}"), ("half", f"2025H{(q + 1) // 2}"), ("year", "2025")):
                for scope, section in (("section", g["donation_section"]), ("all", None)):
                    found.setdefault((level, period, scope, section), set()).add(donor)
    return sorted(((*k, len(v)) for k, v in found.items()), key=repr)


def test_rollup_equals_counting(table):
    gifts = gifts_of(table, random.Random(1), 1500)
    got = roll.oneoff_rollup(roll.donor_bitmaps(table("transactions", *gifts), YEAR))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(gifts)
    assert roll.oneoff_rollup(roll.donor_bitmaps(table("transactions"), YEAR)).count() == 0


def test_stored_months_are_joined_without_the_gifts(spark, table, tmp_path):
    gifts = gifts_of(table, random.Random(2), 600)
    table("transactions", *gifts).write.parquet(str(tmp_path / "transactions"))
    source, path = spark.read.parquet(str(tmp_path / "transactions")), str(tmp_path / "bitmaps")
    for month in Period.quarter(2025, 1).months():
        for _ in range(2):
            roll.store_bitmaps(source, month, path)
    roll.store_bitmaps(source, Period.month(2025, 4), path)  # outside the quarter that is asked for
    got = roll.oneoff_rollup(roll.stored_bitmaps(source, path, Period.quarter(2025, 1)))
    quarter = [g for g in gifts if g["send_date"] and g["send_date"] < date(2025, 4, 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(quarter)
    text = plan(got)
    assert "/transactions]" not in text and "PartitionFilters: [" in text and "report_period" in text
