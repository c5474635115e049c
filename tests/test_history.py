"""The report of a range of months against the reports of its single months."""

import json
import random
from datetime import date, timedelta

import pytest

from retenta import Period
from retenta import __main__ as cli
from retenta.plans import history
from retenta.plans import retention as ret
from retenta.sources import REPORTS, Sources, read_report
from verification.standin import StandIns

from test_plans import plan
from test_retention import CHANNELS

SPAN = Period.trailing(2026, 6, 24)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def single_months(pledges, contacts, channels, span, **options):
    return sorted((r for m in span.months() for r in rows(ret.donor_retention_summary(pledges, contacts, channels, m, **options))), key=repr)


def random_tables(table, rng, n):
    day = lambda: rng.choice([None, date(2024, 1, 1) + timedelta(rng.randrange(1200)), SPAN.start, SPAN.end_exclusive, SPAN.last_day])
    month = lambda d: d and d.strftime("%Y-%m")
    pledges = [{"pledge_uid": i, "donor_no": rng.choice([None, i // 2, i // 2, i // 2]), "submit_date": day(), "start_month": rng.choice(["2025-01"] * 4 + [None]),
                "end_month": month(day()) if rng.random() < 0.3 else None, "cancel_cal_date": rng.choice([None, None, str(day() or "2025-02-28")]),
                "payment_method": rng.choice(["CMS", "NPay", None, "x"]), "campaign_raw": rng.choice(["a/b/1", "r/e/1", "c/o", "u/p", "n/o", "zz", None]),
                "user_type2": rng.choice([None, None, None, "기타", "수시"])} for i in range(n)]
    contacts = [{"donor_no": i, "name": rng.choice(["kim", "test", None]), "contact_date": day(), "cancel_date": day(), "all_end_date": day(),
                 "payment_method": "CMS", "cancel_route": rng.choice(["전화", "후원자관리팀", None]), "cancel_reason": rng.choice(["x", "장기미납 3M"])} for i in range(n // 2)]
    return table("pledges", *pledges), table("contacts", *contacts), table("channel_gb", *CHANNELS)


@pytest.mark.parametrize("coalesce_period", [True, False])
def test_a_history_equals_its_single_months(spark, table, coalesce_period):
    pledges, contacts, channels = random_tables(table, random.Random(3), 300)
    span = SPAN if coalesce_period else Period.trailing(2026, 6, 3)
    got = rows(history.retention_history(pledges, contacts, channels, span, coalesce_period=coalesce_period))
    assert got == single_months(pledges, contacts, channels, span, coalesce_period=coalesce_period) and len(got) > 3


def test_a_pledge_is_active_from_signing_to_the_month_before_its_end(table):
    pledges = table("pledges", {"pledge_uid": 1, "donor_no": 1, "submit_date": date(2025, 3, 31), "start_month": "2025-04", "payment_method": "CMS",
                                "campaign_raw": "a/b/1", "end_month": "2025-06"})
    contacts = table("contacts", {"donor_no": 1, "name": "kim"})
    got = history.retention_history(pledges, contacts, table("channel_gb", *CHANNELS), Period.year(2025)).collect()
    assert [(r.period, r.new_donor, r.active_donor) for r in got] == [("2025-03", 1, 1), ("2025-04", 0, 1), ("2025-05", 0, 1)]


def test_tables_may_be_empty(table):
    got = history.retention_history(table("pledges"), table("contacts"), table("channel_gb", *CHANNELS), SPAN)
    assert got.count() == 0 and got.columns == REPORTS["retention_report"].fieldNames()


def test_only_whole_months_can_be_asked_for():
    assert [m.label for m in Period.trailing(2026, 2, 3).months()] == ["2025-12", "2026-01", "2026-02"]
    with pytest.raises(ValueError, match="whole months"):
        Period(date(2026, 1, 2), date(2026, 2, 1), "odd").months()


def test_more_months_read_the_pledges_no_more_often(spark, tmp_path):
    tables = StandIns(spark, "/root/testdata/sf0.001")
    for name in ("pledges", "contacts", "channel_gb"):
        tables[name].write.parquet(str(tmp_path / name))
    file = tmp_path / "places.json"
    file.write_text(json.dumps({n: str(tmp_path / n) for n in ("pledges", "contacts", "channel_gb")}), encoding="utf-8")
    src = Sources(spark, json.loads(file.read_text(encoding="utf-8")))
    scans = [plan(history.retention_history(src["pledges"], src["contacts"], src["channel_gb"], Period.trailing(1998, 12, n))).count("/pledges]") for n in (1, 24)]
    single = plan(ret.donor_retention_summary(src["pledges"], src["contacts"], src["channel_gb"], Period.month(1998, 6))).count("/pledges]")
    assert scans[0] == scans[1] == single > 0
    out = str(tmp_path / "out")
    cli.main(["history", "1998-05:1998-07", str(file), out])
    stored = read_report(spark, REPORTS["retention_report"], f"{out}/retention_report")
    assert {r.report_period for r in stored.collect()} == {"1998-05", "1998-06", "1998-07"}
    june = stored.filter("report_period = '1998-06'").drop("report_period")
    assert rows(june) == single_months(src["pledges"], src["contacts"], src["channel_gb"], Period.month(1998, 6), coalesce_period=True)
