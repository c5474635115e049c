from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retenta import Period
from retenta.operators import RunFolder, first_per_key, follow_merges, joins, sieved, staged
from retenta.plans import lists

JUNE, Q2, H1 = Period.month(2026, 6), Period.quarter(2026, 2), Period.half(2026, 1)


def gift(uid, donor, day, campaign="F2F/a", kind="Regular", acq="Acquisition", site="1.1 F2F"):
    return {"transaction_id": uid, "supporter_id": donor, "transaction_date": day, "campaign_id": campaign,
            "transaction_type": kind, "acq_gb_simple": acq, "sitecode": site}


def paid(table, *uids):
    return table("transactions", *[{"tran_uid": u, "tran_amount": Decimal("100.50")} for u in uids])


def donors(frame):
    return sorted(r.donor_no for r in frame.collect())


def test_new_donor_is_settled_over_the_year_before_the_month_is_cut(table):
    june, may = date(2026, 6, 30), date(2026, 5, 1)
    gifts = table(
        "classified_gifts", gift("a", 1, june), gift("b", 2, may), gift("c", 2, june), gift("d", 3, date(2025, 12, 31)),
        gift("e", 3, june), gift("f", 4, june, acq="Existing"), gift("g", 5, june, site=None), gift("h", 6, june, site="2.%"),
        gift("i", 7, june, site="2.6 Conversion"), gift("j", 8, june, "UPGRADE/x"), gift("k", 9, june, "PphCorp/x"),
        gift("l", 10, june, None), gift("m", 11, date(2026, 7, 1)), gift("n", 12, june), gift("o", 13, june, "Cash_SMS"),
    )
    paid_ids = paid(table, *"abcdefghijklmo")
    assert donors(lists.new_donor_month(gifts, paid_ids, JUNE)) == [1, 3, 7]
    assert donors(lists.new_donor_month(gifts, paid_ids, JUNE, site_code_prefix_rule=True)) == [1, 3]
    assert donors(lists.new_donor_quarter(gifts, paid_ids, Period.ytd(2026, 6))) == [1, 2, 3, 7, 8, 13]
    amount = lists.new_donor_month(gifts, paid_ids, JUNE).collect()[0].tran_amount
    assert amount == 101  # rounded, not cut


def test_tied_first_gifts_go_to_the_lower_id(table):
    day = date(2026, 6, 1)
    gifts = table("classified_gifts", gift("b", 1, day, "F2F/b"), gift("a", 1, day, "F2F/a"))
    rows = lists.new_donor_month(gifts, paid(table, "a", "b"), JUNE).collect()
    assert [r.campaign_id for r in rows] == ["F2F/a"]


def test_active_donors(table):
    gifts = table("gift_facts", *[
        {"supporter_id": d, "transaction_type": k, "transaction_date": day}
        for d, k, day in ((1, "Regular", date(2025, 7, 1)), (1, "Single", date(2026, 1, 1)), (2, "Single", date(2026, 6, 30)),
                          (3, "Regular", date(2026, 1, 1)), (4, "Regular", date(2026, 1, 1)), (5, "Single", date(2025, 6, 30)),
                          (6, "Regular", date(2026, 1, 1)), (7, None, date(2026, 1, 1)), (8, "Single", date(2026, 1, 1)))])
    contacts = table("contacts", {"donor_no": 1}, {"donor_no": 2, "all_end_date": date(2026, 1, 1)},
                     {"donor_no": 3, "all_end_date": date(2026, 1, 1)}, {"donor_no": 4, "all_end_date": date(2025, 6, 30)},
                     {"donor_no": 5}, {"donor_no": 6, "all_end_date": date(2026, 7, 1)}, {"donor_no": 7})
    rows = lists.active_donor_summary(gifts, contacts, Period.trailing(2026, 6), "2026Q2").collect()
    # Ended before the window counts, ended within it does not; no contact does not.
    assert {(r.reporting, r.donor_type, r.supporter_count) for r in rows} == {("2026Q2", "RG", 3), ("2026Q2", "Pure OO", 2)}


def test_reactivation_ranks_all_history_per_campaign(table):
    apr, old = date(2026, 4, 1), date(2025, 1, 1)
    gifts = table(
        "classified_gifts", gift("a", 1, old, "Reactivation/1", acq="Existing"), gift("b", 1, apr, "Reactivation/1", acq="Existing"),
        gift("c", 1, apr, "Reactivation/2", acq="Existing"), gift("d", 2, apr, "Reactivation/1"),
        gift("e", 3, date(2026, 6, 30), "Reactivation/1", acq="Existing"), gift("f", 4, apr, "F2F", acq="Existing"),
    )
    rows = lists.reactivation_list(gifts, paid(table, *"abcdef"), Q2).collect()
    assert sorted((r.donor_no, r.campaign_id) for r in rows) == [(1, "Reactivation/2"), (3, "Reactivation/1")]


def test_conversion_beside_first_single_gift(table):
    apr = date(2026, 4, 1)
    gifts = table(
        "classified_gifts", gift("a", 1, apr, "CONVERSION/1"), gift("b", 1, date(2024, 1, 1), "X", "Single"),
        gift("c", 1, date(2025, 1, 1), "Y", "Single"), gift("d", 2, apr, "CONVERSION/1"), gift("e", 3, apr, "Conversion/1"),
    )
    rows = lists.conversion_list(gifts, paid(table, *"abcde"), Q2).collect()
    assert [(r.donor_no, r.first_oo_campaign_id, r.conversion_amount) for r in rows] == [
        (1, "X", Decimal("100.50")), (2, None, Decimal("100.50"))]


def conversions(spark, *rows):
    return spark.createDataFrame(list(rows), "donor_no bigint, conversion_date date, conversion_acq_gb_simple string")


def test_membership_and_merged_numbers(table, spark):
    day = date(2026, 3, 1)
    conv = conversions(spark, (1, day, "Acquisition"), (2, day, "Acquisition"), (3, day, "Existing"), (4, date(2026, 7, 1), "Acquisition"),
                       (5, day, "Acquisition"))
    new = spark.createDataFrame([(1,), (1,), (20,), (501,)], "donor_no bigint")
    checked = lists.conversion_in_new_donor(conv, new, H1)
    assert sorted((r.donor_no, r.in_new_donor) for r in checked.collect()) == [(1, "Y"), (2, "N"), (5, "N")]
    header = table("merge_history", {"merge_id": 7, "surviving_member_no": 2}, {"merge_id": 8, "surviving_member_no": 20},
                   {"merge_id": 9, "surviving_member_no": 5}, {"merge_id": 10, "surviving_member_no": 500})
    detail = table("merge_history_detail", {"merge_id": 7, "merged_member_no": 20}, {"merge_id": 7, "merged_member_no": 21},
                   {"merge_id": 8, "merged_member_no": 30}, {"merge_id": 9, "merged_member_no": 500},
                   {"merge_id": 10, "merged_member_no": 501})
    one_step = lists.resolve_merged_donors(checked, header, detail, new).collect()
    assert sorted((r.surviving_member_no, r.merged_member_no, r.listed_under_merged_no) for r in one_step) == [
        (2, 20, "Y"), (2, 21, "N"), (5, 500, "N")]
    chained = lists.resolve_merged_donors(checked, header, detail, new, through_chains=True).collect()
    assert (5, 501, "Y") in {(r.surviving_member_no, r.merged_member_no, r.listed_under_merged_no) for r in chained}


def test_missing_conversion_without_merge_is_kept(table, spark):
    checked = lists.conversion_in_new_donor(
        conversions(spark, (9, date(2026, 3, 1), "Acquisition")), spark.createDataFrame([(1,)], "donor_no bigint"), H1)
    rows = lists.resolve_merged_donors(checked, table("merge_history"), table("merge_history_detail"),
                                       spark.createDataFrame([(1,)], "donor_no bigint")).collect()
    assert [(r.surviving_member_no, r.merged_member_no, r.listed_under_merged_no) for r in rows] == [(9, None, "N")]


@pytest.mark.parametrize("length", [1, 2, 7, 20])
def test_follow_merges_to_the_end_of_a_chain(spark, length):
    links = spark.createDataFrame([(i, i + 1) for i in range(length)], "merged_member_no bigint, surviving_member_no bigint")
    assert sorted(tuple(r) for r in follow_merges(links).collect()) == [(i, length) for i in range(length)]


def test_follow_merges_refuses_circles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "merged_member_no bigint, surviving_member_no bigint")
    with pytest.raises(ValueError, match="circle"):
        follow_merges(links)


def test_read_out_sorts_and_cuts(spark):
    frame = spark.createDataFrame([(2, date(2026, 6, 30)), (1, date(2026, 6, 30)), (3, date(2026, 1, 1)), (4, date(2026, 7, 1))],
                                  "donor_no bigint, d date")
    assert [r.donor_no for r in lists.read_out(frame, "d", H1).collect()] == [3, 1, 2]
    assert [r.donor_no for r in lists.quarter_slice(frame, "d", Q2, ["donor_no"]).orderBy("donor_no").collect()] == [1, 2]


def test_first_per_key_gives_one_row_per_key(spark):
    frame = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    assert sorted((r.k, r.v) for r in first_per_key(frame, ["k"], ["v"]).collect()) == [(i, i) for i in range(7)]


def test_a_sieve_keeps_all_wanted_rows_and_few_others(spark, tmp_path):
    wanted = staged(spark.range(0, 200).select(F.concat(F.lit("t"), F.col("id") * 7).alias("uid")), str(tmp_path), "wanted")
    gifts = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id")).alias("tran_uid")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    kept = [r.tran_uid for r in sieved(gifts.union(gifts), "tran_uid", wanted).collect()]
    hits = [f"t{7 * i}" for i in range(200) for _ in range(2)]
    assert sorted(u for u in kept if u in set(hits)) == sorted(hits) and len(kept) < 400 + 40_000 / 8
    assert sieved(gifts, "tran_uid", staged(wanted.limit(0), str(tmp_path), "none")).count() == 0


def test_a_sieve_of_too_many_keys_loses_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "SIEVE_MOST", 64)
    wanted = staged(spark.range(500), str(tmp_path), "many")
    assert sieved(spark.range(1000), "id", wanted).filter("id < 500").count() == 500


def test_stored_lists_are_those_of_lazy_ones_and_sieve_the_gifts(spark, table, tmp_path):
    gifts = table("classified_gifts", *[gift(f"g{i}", i % 40, date(2026, 1 + i % 6, 1 + i % 28), c, k) for i in range(200)
                                        for c, k in [(("F2F/a", "Regular"), ("CONVERSION/TM/02", "Single"), ("Reactivation/TM/01", "Single"))[i % 3]]])
    uids = [f"g{i}" for i in range(150)] + ["g1", "g1", "g4", None] + [f"other{i}" for i in range(3000)]  # some missing, some twice
    table("transactions", *[{"tran_uid": u, "tran_amount": Decimal(i)} for i, u in enumerate(uids)]).write.parquet(str(tmp_path / "transactions"))
    paid_gifts = spark.read.parquet(str(tmp_path / "transactions"))
    stage, year = RunFolder(spark, str(tmp_path)), Period.year(2026)
    for make in (lambda **s: lists.new_donor_quarter(gifts, paid_gifts, Period.ytd(2026, 6), **s), lambda **s: lists.conversion_list(gifts, paid_gifts, year, **s),
                 lambda **s: lists.reactivation_list(gifts.withColumn("acq_gb_simple", F.lit("Existing")), paid_gifts, year, **s)):
        stored = make(stage=stage)
        assert sorted(map(repr, stored.collect())) == sorted(map(repr, make().collect()))
        assert "getbit" in stored._jdf.queryExecution().optimizedPlan().toString()


def test_the_sieve_goes_below_the_join_that_makes_the_gifts(spark, tmp_path):
    left, right = (staged(spark.range(100).select("id", F.col("id").alias(n)), str(tmp_path), n) for n in ("a", "b"))
    text = sieved(left.join(right, "id"), "a", staged(spark.range(3), str(tmp_path), "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < text.index("getbit")
