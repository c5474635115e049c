from datetime import date

import pytest
from pyspark.sql import functions as F

from retenta.operators import duplicate_keys, require_unique
from retenta.operators.quality import DuplicateKeys
from retenta.sources import REPORTS, TABLES, Sources, append_period, create_or_replace, read_report, rewrite_without
from retenta.sources.catalog import SchemaMismatch

NEW = REPORTS["new_donor"]


def new_donors(spark, *rows):
    return spark.createDataFrame(
        [(d, "Regular", day, 100, "CMS", "F2F", "F2F", "s", "Acquisition", "1.1") for d, day in rows], NEW)


def test_parquet_is_checked_pruned_and_ordered(spark, table, tmp_path):
    path = str(tmp_path / "zips")
    table("zip_code_region", {"zip_code": "11", "gb": "old_zip", "region": "x"}).selectExpr("region", "gb", "zip_code", "1 AS extra").write.parquet(path)
    assert Sources(spark, {"zip_code_region": path})["zip_code_region"].columns == ["zip_code", "gb", "region"]


def test_missing_or_mistyped_columns_fail_early(spark, tmp_path):
    path = str(tmp_path / "zips")
    spark.sql("SELECT 11 AS zip_code, 'a' AS gb").write.parquet(path)
    with pytest.raises(SchemaMismatch, match="missing \\['region'\\].*zip_code is int"):
        Sources(spark, {"zip_code_region": path})["zip_code_region"]


def test_renamed_columns_and_catalog_table(spark, tmp_path):
    path = str(tmp_path / "zips")
    spark.sql("SELECT '11' AS code, 'a' AS gb, 'r' AS region").write.parquet(path)
    sources = Sources(spark, {"zip_code_region": {"format": "parquet", "path": path, "columns": {"code": "zip_code"}}})
    assert sources["zip_code_region"].collect()[0].zip_code == "11"
    sources.register_views("zip_code_region")
    view = Sources(spark, {"zip_code_region": {"format": "table", "name": "zip_code_region"}})
    assert view["zip_code_region"].collect()[0].region == "r"


def test_csv_upload_is_read_as_text_and_cast(spark, tmp_path):
    path = tmp_path / "income.csv"
    path.write_text("donor_no,donation_spend,channel_raw,donor_type\n7,10000,F2F/UP,수시\n8,,,\n", encoding="utf-8")
    income = Sources(spark, {"income": {"format": "csv", "path": str(path)}})["income"]
    assert income.schema == TABLES["income"]
    assert [tuple(r) for r in income.orderBy("donor_no").collect()] == [(7, "10000", "F2F/UP", "수시"), (8, None, None, None)]


def test_a_period_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "new")
    may, june = date(2026, 5, 1), date(2026, 6, 1)
    append_period(new_donors(spark, (1, may)), NEW, path, "2605")
    append_period(new_donors(spark, (2, june), (3, june)), NEW, path, "2606")
    append_period(new_donors(spark, (2, june), (4, june)), NEW, path, "2606")
    stored = read_report(spark, NEW, path)
    assert sorted((r.donor_no, r.report_period) for r in stored.collect()) == [(1, "2605"), (2, "2606"), (4, "2606")]


def test_append_goes_by_name_and_type(spark, tmp_path):
    path = str(tmp_path / "new")
    given = new_donors(spark, (1, date(2026, 5, 1)))
    swapped = given.withColumn("tran_amount", given.tran_amount.cast("string")).selectExpr("*", "'x' AS extra")
    append_period(swapped.select(*reversed(swapped.columns)), NEW, path, "2605")
    row = read_report(spark, NEW, path).collect()[0]
    assert (row.donor_no, row.tran_amount, row.sitecode) == (1, 100, "1.1")
    assert "extra" not in row.asDict()


def test_create_or_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    create_or_replace(spark.range(5), path)
    create_or_replace(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_rewrite_without_keeps_both_parts(spark, tmp_path):
    path, audit = str(tmp_path / "new"), str(tmp_path / "audit")
    day = date(2026, 5, 1)
    append_period(new_donors(spark, (1, day), (2, day)), NEW, path, "2605")
    append_period(new_donors(spark, (9, day)), NEW, path, "2604")
    stored = read_report(spark, NEW, path).filter("report_period = '2605'")
    rewrite_without(stored.filter("donor_no = 1"), stored.filter("donor_no <> 1"), NEW, path, "2605", audit)
    assert sorted((r.donor_no, r.report_period) for r in read_report(spark, NEW, path).collect()) == [(1, "2605"), (9, "2604")]
    assert [r.donor_no for r in spark.read.parquet(audit + "/removed/2605").collect()] == [2]


def test_duplicate_keys(table):
    channels = table("channel_gb", *[{"channel_t": c, "acq_gb": a} for c, a in (("x", "E"), ("x", "E"), ("y", "E"), (None, "E"), (None, "E"))])
    assert [tuple(r) for r in duplicate_keys(channels, ["channel_t", "acq_gb"]).collect()] == [("x", "E", 2)]
    with pytest.raises(DuplicateKeys, match="channel"):
        require_unique(channels, ["channel_t"], "channel_gb")
    require_unique(channels.filter("channel_t = 'y'"), ["channel_t"], "channel_gb")


def test_report_types():
    assert [f.name for f in REPORTS["oo_profile"].fields][-4:] == [
        "oo_tygift_band_order", "age_band_order", "life_year_band_order", "region_3_order"]
    assert [len(REPORTS[n].fields) for n in ("retention_report", "new_donor", "rg_profile", "oo_profile")] == [14, 10, 21, 26]


def test_an_empty_result_replaces_its_period(spark, tmp_path):
    path = str(tmp_path / "new")
    append_period(new_donors(spark, (1, date(2026, 5, 1)), (2, date(2026, 5, 2))), NEW, path, "2605")
    append_period(new_donors(spark, (3, date(2026, 4, 1))), NEW, path, "2604")
    append_period(new_donors(spark, (1, date(2026, 5, 1))).filter("false"), NEW, path, "2605")
    assert [(r.donor_no, r.report_period) for r in read_report(spark, NEW, path).collect()] == [(3, "2604")]


def test_removed_rows_outlive_a_second_run_and_all_rows_can_go(spark, tmp_path):
    path, audit = str(tmp_path / "new"), str(tmp_path / "audit")
    append_period(new_donors(spark, (1, date(2026, 5, 1)), (2, date(2026, 5, 1))), NEW, path, "2605")
    for _ in range(2):
        stored = read_report(spark, NEW, path).filter("report_period = '2605'")
        rewrite_without(stored.filter("donor_no > 2"), stored.filter("donor_no <= 2"), NEW, path, "2605", audit)
        assert read_report(spark, NEW, path).count() == 0
        assert sorted(r.donor_no for r in spark.read.parquet(audit + "/removed/2605").collect()) == [1, 2]


def test_a_run_that_fails_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "new")
    append_period(new_donors(spark, (1, date(2026, 5, 1))), NEW, path, "2605")
    broken = new_donors(spark, (2, date(2026, 5, 1))).withColumn("donor_no", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        append_period(broken, NEW, path, "2605")
    assert [r.donor_no for r in read_report(spark, NEW, path).collect()] == [1]
    assert not [f for f in (tmp_path / "new").iterdir() if f.name.startswith("_new")]


def test_a_period_may_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "new")
    append_period(new_donors(spark, (1, date(2026, 5, 1)), (2, date(2026, 5, 2))), NEW, path, "2605")
    stored = read_report(spark, NEW, path).filter("report_period = '2605'")
    append_period(stored.filter("donor_no = 2"), NEW, path, "2605")
    assert [r.donor_no for r in read_report(spark, NEW, path).collect()] == [2]


def test_rows_removed_again_stand_once_in_the_audit_copy(spark, tmp_path):
    path, audit = str(tmp_path / "new"), str(tmp_path / "audit")
    for _ in range(2):  # the year is run anew, with the bad rows in it again
        append_period(new_donors(spark, (1, date(2026, 5, 1)), (2, date(2026, 5, 1)), (2, date(2026, 5, 1))), NEW, path, "2605")
        stored = read_report(spark, NEW, path).filter("report_period = '2605'")
        rewrite_without(stored.filter("donor_no = 1"), stored.filter("donor_no = 2"), NEW, path, "2605", audit)
    assert [r.donor_no for r in spark.read.parquet(audit + "/removed/2605").collect()] == [2, 2]
