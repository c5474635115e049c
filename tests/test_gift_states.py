"""Stored first and last gifts: refreshed by months, they equal those of all gifts."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retenta import Period
from retenta.plans import commitments as com
from retenta.sources import gift_states
from retenta.sources.gift_states import GiftStates

from test_plans import plan, scan_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_gifts(rng, n, first=0):
    return [{"tran_uid": f"t{first + i}", "pledge_uid": rng.choice([None, *range(12)]), "donor_no": 1, "tran_amount": rng.choice([None, Decimal(5), Decimal(10)]),
             "send_date": rng.choice([None, date(2024, 11, 1) + timedelta(rng.randrange(150)), date(2025, 1, 1), date(2025, 1, 31)])} for i in range(n)]


@pytest.fixture
def states(spark, tmp_path):
    return GiftStates(spark, str(tmp_path / "states"))


def months_of(*gift_lists):
    days = {g["send_date"] for gifts in gift_lists for g in gifts if g["send_date"]}
    return [Period.month(y, m) for y, m in sorted({(d.year, d.month) for d in days})]


def test_late_and_corrected_gifts(table, states):
    rng = random.Random(1)
    gifts = some_gifts(rng, 200)
    before = table("transactions", *gifts)
    states.build(before)
    assert rows(com.extremes_of(states.state(before))) == rows(com.gift_extremes(before))
    late = some_gifts(rng, 10, 1000)  # of any date, also none
    wrong, kept = gifts[:12], gifts[12:]  # corrected: other amount, another date, or gone
    right = [{**g, "tran_amount": Decimal(7)} for g in wrong[:4]] + [{**g, "send_date": date(2025, 3, 15)} for g in wrong[4:8]]
    after = table("transactions", *kept, *late, *right)
    states.refresh(after, months_of(late, wrong, right))
    assert rows(com.extremes_of(states.state(after))) == rows(com.gift_extremes(after))
    states.refresh(after, months_of(late))  # again, with no change
    assert rows(com.extremes_of(states.state(after))) == rows(com.gift_extremes(after))


def test_merging_is_associative(table):
    rng = random.Random(2)
    parts = [table("transactions", *some_gifts(rng, 40, 100 * i)) for i in range(3)]
    a, b, c = (com.gift_state(x) for x in parts)
    whole = com.gift_state(parts[0].union(parts[1]).union(parts[2]))
    left = com.merged(com.merged(a.union(b)).union(c))
    right = com.merged(c.union(com.merged(b.union(a))))
    assert rows(left) == rows(right) == rows(whole)


def test_a_new_month_and_an_emptied_one(table, states):
    gift = {"tran_uid": "a", "pledge_uid": 1, "tran_amount": Decimal(5), "send_date": date(2025, 12, 31)}
    before = table("transactions", gift)
    states.build(before)
    after = table("transactions", {**gift, "send_date": date(2026, 1, 1)})
    states.refresh(after, [Period.month(2025, 12), Period.month(2026, 1)])
    assert rows(com.extremes_of(states.state(after))) == [(1, 5, 5, date(2026, 1, 1))]
    nothing = table("transactions")
    states.refresh(nothing, [Period.month(2026, 1)])
    assert rows(states.state(nothing)) == []


def test_the_view_reads_no_gifts_and_a_refresh_reads_its_months(spark, table, states, tmp_path):
    table("transactions", *some_gifts(random.Random(4), 50)).write.parquet(str(tmp_path / "transactions"))
    gifts = spark.read.parquet(str(tmp_path / "transactions"))
    states.build(gifts)
    view = com.commitment_view_of(table("pledges"), com.extremes_of(states.state(gifts)), table("contacts"), table("campaigns"), date(2025, 6, 1), date(2025, 6, 1))
    text = plan(view)
    assert "/transactions]" not in text and "/states/years]" in text and "/states/months]" not in text
    month = Period.month(2025, 1)
    assert "GreaterThanOrEqual(send_date,2025-01-01)" in scan_of(plan(com.gift_state(gifts.filter(month.holds(gifts["send_date"])))), "transactions")


def test_a_build_shuffles_the_gifts_once(table, states, monkeypatch):
    gifts = table("transactions", *some_gifts(random.Random(5), 300))
    written = []
    replace = gift_states.replace_folders
    monkeypatch.setattr(gift_states, "replace_folders", lambda df, *a: (written.append(df), replace(df, *a)))
    states.build(gifts)
    (both,) = written
    both.collect()
    text = plan(both)
    shuffles = [line for line in text.split("\n== Initial Plan")[0].splitlines() if re.search(r"\bExchange (hash|range|round|single)", line, re.I)]
    assert "ReusedExchange" in text and "rangepartitioning(gift_year" in text
    assert "hashpartitioning" not in text and len(shuffles) <= 2, shuffles


def test_stored_months_and_years_are_the_states_of_their_gifts(table, states):
    gifts = table("transactions", *some_gifts(random.Random(6), 300))
    states.build(gifts)
    day = F.col("send_date")
    for name, partition, pattern in (("months", "gift_month", "yyyy-MM"), ("years", "gift_year", "yyyy")):
        label = F.coalesce(F.date_format(day, pattern), F.lit("undated"))
        expected = com.gift_state(gifts.withColumn(partition, label), partition).select("pledge_uid", "first_gift", "last_gift", partition)
        assert rows(states._read(name, partition, gifts)) == rows(expected)


def test_a_single_gift_is_stored_once(spark, table, states):
    gift = {"tran_uid": "a", "pledge_uid": 1, "tran_amount": None, "send_date": date(2025, 3, 1)}
    gifts = table("transactions", gift, {**gift, "tran_uid": "b", "pledge_uid": 2}, {**gift, "tran_uid": "c", "pledge_uid": 2})
    states.build(gifts)
    stored = spark.read.parquet(f"{states.path}/months").select("pledge_uid", "first_gift.tran_uid", F.col("last_gift.tran_uid").alias("last"))
    assert rows(stored) == [(1, "a", None), (2, "b", "c")]
    assert rows(com.extremes_of(states.state(gifts))) == rows(com.gift_extremes(gifts))


def test_a_build_without_gifts_takes_the_place_of_an_earlier_one(table, states):
    states.build(table("transactions", *some_gifts(random.Random(7), 20)))
    nothing = table("transactions")
    states.build(nothing)
    assert rows(states.state(nothing)) == []
