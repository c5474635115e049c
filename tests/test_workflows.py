"""Whole runs over stand-in tables stored as parquet, started from the command line entry."""

import json

import pytest
from pyspark.sql import functions as F

from retenta import Period
from retenta import __main__ as cli
from retenta import workflows
from retenta.operators.quality import DuplicateKeys
from retenta.sources import REPORTS, TABLES, Sources, read_report
from verification import periods
from verification.standin import StandIns

SF = "/root/testdata/sf0.001"
NEEDED = ("pledges", "contacts", "channel_gb", "classified_gifts", "transactions", "income", "zip_code_region", "ltv_gifts",
          "ltv_channel_gb", "don_section", "campaigns", "gift_facts", "change_history", "cms_results", "crm_contacts",
          "bank_ledger", "case_log", "merge_history", "merge_history_detail")


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    root, tables = tmp_path_factory.mktemp("tables"), StandIns(spark, SF)
    for name in NEEDED:
        table = tables[name].dropDuplicates(["tran_uid"]) if name == "transactions" else tables[name]
        table.write.parquet(str(root / name))
    file = root / "places.json"
    file.write_text(json.dumps({name: str(root / name) for name in NEEDED}), encoding="utf-8")
    return file


def stored(spark, out, report):
    return read_report(spark, REPORTS[report], f"{out}/{report}")


def test_runs_write_their_period_once(spark, places, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        cli.main(["month", "1998-06", str(places), out])
    cli.main(["month", "1998-05", str(places), out])
    report = stored(spark, out, "retention_report")
    assert {r.report_period for r in report.select("report_period").distinct().collect()} == {"1998-05", "1998-06"}
    june = report.filter("report_period = '1998-06'")
    assert june.count() == june.distinct().count() > 0
    assert june.agg(F.sum("active_donor")).collect()[0][0] > 0
    with pytest.raises(workflows.MissingMonths, match="1998-04"):
        cli.main(["quarter", "1998Q2", str(places), out])
    cli.main(["month", "1998-04", str(places), out])
    cli.main(["quarter", "1998Q2", str(places), out])
    assert not list((tmp_path / "_staging").iterdir())
    assert stored(spark, out, "conversion_donor").filter("conversion_date < '1998-04-01'").count() == 0


def test_year_and_outliers(spark, places, tmp_path):
    out = str(tmp_path)
    cli.main(["year", "1998", str(places), out])
    before = stored(spark, out, "rg_profile").count()
    sources = Sources(spark, json.loads(places.read_text(encoding="utf-8")))
    workflows.remove_rg_outliers(sources, periods.YEAR, out, [{"channel_g2": "ONLINE"}])
    after = stored(spark, out, "rg_profile")
    removed = spark.read.parquet(f"{out}/audit/rg_profile/removed/1998")
    assert removed.count() > 0 and after.count() + removed.count() == before
    assert after.filter("channel_g2 = 'ONLINE'").count() == 0
    assert stored(spark, out, "oo_profile").count() > 0


def test_commitment_view_can_be_replaced(spark, places, tmp_path):
    sources = Sources(spark, json.loads(places.read_text(encoding="utf-8")))
    for _ in range(2):
        workflows.refresh_commitment_view(sources, str(tmp_path), periods.AS_OF, periods.LOADED_AT)
    view = spark.read.parquet(str(tmp_path / "commitment_view"))
    assert view.count() == view.select("commitment_id").distinct().count() > 0


def test_a_repeated_lookup_key_stops_the_run(spark, places, tmp_path):
    again = spark.read.parquet(str(places.parent / "channel_gb"))
    again.unionByName(again).write.parquet(str(tmp_path / "channel_gb"))
    sources = Sources(spark, {"channel_gb": str(tmp_path / "channel_gb")})
    with pytest.raises(DuplicateKeys):
        workflows.run_month(sources, periods.MONTH, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_every_table_has_a_stand_in(spark):
    tables = StandIns(spark, SF)
    for name, schema in TABLES.items():
        assert [(f.name, f.dataType) for f in tables[name].schema.fields] == [(f.name, f.dataType) for f in schema.fields]


def test_month_counts_and_quarter_from_stored_lists(spark, places, tmp_path):
    out = str(tmp_path)
    sources = Sources(spark, json.loads(places.read_text(encoding="utf-8")))
    for month in (4, 5, 6):
        workflows.run_month(sources, Period.month(1998, month), out)
    workflows.run_quarter(sources, periods.QUARTER, out)
    monthly = stored(spark, out, "new_donor").drop("report_period")
    quarterly = stored(spark, out, "quarter_new_donor").drop("report_period").collect()
    assert sorted(map(str, monthly.collect())) == sorted(map(str, quarterly)) != []
    workflows.run_quarter(sources, periods.QUARTER, out, redraw=True)
    redrawn = stored(spark, out, "quarter_new_donor")
    assert redrawn.count() > len(quarterly)
    assert {r.donor_type for r in stored(spark, out, "active_donor_summary").collect()} == {"RG", "Pure OO"}
    kept = {n: spark.read.parquet(f"{out}/{n}/report_period={periods.QUARTER.label}") for n in (
        "new_donor_readout", "reactivation_readout", "conversion_readout", "conversion_in_new_donor", "former_member_numbers")}
    assert kept["new_donor_readout"].count() == redrawn.count()
    assert kept["conversion_readout"].count() == stored(spark, out, "conversion_donor").count() > 0
    checked = kept["conversion_in_new_donor"]
    assert {r.in_new_donor for r in checked.collect()} <= {"Y", "N"}
    missing = checked.filter("in_new_donor = 'N'").select("donor_no").distinct().count()
    assert kept["former_member_numbers"].select("surviving_member_no").distinct().count() == missing
    cli.main(["counts", "1998-06", str(places), out])
    cli.main(["view", "1998-07-01", str(places), out])
    assert spark.read.parquet(f"{out}/commitment_view").count() > 0
    for name in ("email_subscribers", "flag_crosstab", "dq_missing_campaign", "refund_list"):
        assert spark.read.parquet(f"{out}/{name}/report_period=1998-06").count() > 0
    counts = workflows.month_counts(sources, periods.MONTH)
    assert counts["email_subscribers"].collect()[0].subscribers > 0
    assert set(counts) == {"oneoff_headcount", "oneoff_by_section", "email_subscribers", "internal_cancel_by_route",
                           "external_cancel_by_route", "bank_income_class", "anonymous_oneoff", "refund_list"}
