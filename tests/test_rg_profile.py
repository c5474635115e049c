from datetime import date
from decimal import Decimal

import pytest

from retenta import Period
from retenta.plans import rg_profile as rg

YEAR = Period.year(2025)
PLEDGE = {"donor_no": 1, "name": "kim", "campaign_raw": "a/b/1", "payment_method": "CMS", "start_month": "2025-01",
          "submit_date": date(2025, 1, 1)}
CONTACT = {"donor_no": 1, "age": 31, "rg_amount": Decimal("10000.00"), "first_month": "2025-03", "home_zip": "4123"}
CHANNEL = {"channel_t": "ab", "acq_gb": "Existing", "channel_excl_upgrade": "F2F SW A"}


@pytest.mark.parametrize(
    ("change", "kept"),
    [
        ({}, True), ({"submit_date": None}, True), ({"submit_date": date(2025, 12, 31)}, True), ({"submit_date": date(2026, 1, 1)}, False),
        ({"all_end_date": date(2025, 12, 31)}, False), ({"all_end_date": date(2026, 1, 1)}, True), ({"campaign_raw": None}, False),
        ({"payment_method": "무통장입금"}, False), ({"start_month": None}, False), ({"end_month": "2025-12"}, False),
        ({"end_month": "2026-01"}, True), ({"user_type2": "기타"}, False), ({"campaign_raw": "UP_x/b"}, False),
        ({"campaign_raw": "UP"}, True), ({"campaign_raw": "PPHx/b"}, False), ({"campaign_raw": "ONEOFF"}, False),
    ],
)
def test_active_base_filters(table, change, kept):
    frame = rg.rg_active_base(table("pledges", {**PLEDGE, "pledge_uid": 1, **change}), YEAR)
    assert (len(frame.collect()) == 1) is kept


def test_active_base_takes_the_latest_pledge_and_counts_all(table):
    days = [None, date(2024, 1, 1), date(2025, 5, 1), date(2025, 5, 1)]
    pledges = table("pledges", *[{**PLEDGE, "pledge_uid": i, "name": f"n{i}", "campaign_raw": f"c{i}/x", "submit_date": d}
                                 for i, d in enumerate(days)])
    assert [tuple(r) for r in rg.rg_active_base(pledges, YEAR).collect()] == [(1, "n3", "c3x", 4)]


def info(table, contact=None, pledge=None):
    base = rg.rg_active_base(table("pledges", {**PLEDGE, "pledge_uid": 1, **(pledge or {})}), YEAR)
    contacts = table("contacts", {**CONTACT, **(contact or {})})
    return rg.rg_donor_info(base, contacts, table("channel_gb", CHANNEL), YEAR)


@pytest.mark.parametrize(
    ("contact", "field", "expected"),
    [
        ({"age": 19}, "age_band", "under 18"), ({"age": 1}, "age_band", "No data"), ({"age": None}, "age_band", "No data"),
        ({"age": 62}, "age_band", "over 61"), ({"rg_amount": Decimal("10000.49")}, "gift_band", "under 10,000"),
        ({"rg_amount": Decimal("10000.50")}, "gift_band", "10,001~15,000"), ({"rg_amount": None}, "gift_band", "No data"),
        ({"first_month": "2025-01"}, "life_year_band", "New Active"), ({"first_month": "2024-12"}, "life_year_band", "Over 1yr"),
        ({"first_month": "2022-12"}, "life_year_band", "Over 3yrs"), ({"first_month": "2021-12"}, "life_year_band", "Over 4yrs"),
        ({"first_month": None}, "life_year_band", "Over 4yrs"), ({"first_month": "2027-01"}, "life_year_band", "New Active"),
        ({"mvd_type": "MVD-A"}, "mvd_gb", "MVD"), ({"mvd_type": "MVD-PP"}, "mvd_gb", None), ({"email_opt": "N"}, "email_opt", False),
        ({"email_opt": None}, "email_opt", True), ({"mail_opt": "수신안함"}, "mail_opt", False), ({}, "all_zip", "04123"),
        ({"home_zip": "123-456"}, "all_zip", "123-456"), ({"home_zip": None, "office_zip": "61"}, "all_zip", "00061"),
        ({"home_zip": None}, "all_zip", ""), ({"home_zip": "1234567"}, "all_zip", "12345"),
        ({"home_zip": "4123", "office_zip": "1-2"}, "all_zip", "4123"),
    ],
)
def test_donor_info(table, contact, field, expected):
    assert info(table, contact).collect()[0][field] == expected


def test_addons_count_a_donor_once_per_cash_type(table):
    income = table("income", *[
        {"donor_no": 1, "donation_spend": s, "channel_raw": c, "donor_type": k}
        for s, c, k in (("10000", "x Cash_SMS", "정기"), ("20001", "x Cash_SMS", "수시"), ("5", "Cash_DM", None), ("7", "Cash_??", None),
                        ("100", "UPGRADE", "정기"), ("201", "x UP", "정기"), ("9", None, None))])
    zips = table("zip_code_region", {"zip_code": "04", "gb": "new_zip", "region": "서울특별시"}, {"zip_code": "04", "gb": "old_zip", "region": "x"})
    addons = rg.rg_addons(info(table), income, zips)
    rows = {r.cash_type: r for r in addons.collect()}
    assert set(rows) == {"Cash_SMS", "Cash_DM", "No_cash_donor"}
    sms = rows["Cash_SMS"]
    assert (sms.cash_count, sms.avg_cash_amt, sms.tot_cash_amt) == (2, 15001, Decimal("30001.00"))
    assert (sms.upgrade, sms.up_count, sms.avg_up_amt, sms.tot_up_amt) == ("RG_Upgrade", 2, 151, Decimal("301.00"))
    assert (sms.cross_sell, sms.oo_count, sms.avg_oo_gift_band) == ("cross_sell", 1, "10,001~50,000")
    assert (sms.region, sms.region_1, sms.region_3) == ("서울특별시", "서울특별시", "Seoul Metropolitan Area")
    profile = rg.rg_profile(addons, YEAR).collect()
    assert sum(r["count"] for r in profile) == 3
    assert {(r.year, r.channel_g2, r.channel_g3, r.tot_avg_age) for r in profile} == {("2025", "F2F AGENCY", "F2F SW_Street", 30)}


def test_addons_of_a_donor_without_income(table):
    row = rg.rg_addons(info(table), table("income"), table("zip_code_region")).collect()[0]
    assert (row.upgrade, row.up_count, row.cash_type, row.cross_sell, row.avg_oo_gift_band, row.oo_count) == (
        "No_Upgrade", None, None, "", "rg_only_donor", None)
    assert (row.region, row.region_1, row.region_2, row.region_3) == ("", "No data", "No data", "No data")
    profile = rg.rg_profile(rg.rg_addons(info(table), table("income"), table("zip_code_region")), YEAR)
    stored = rg.rg_profile_rows(profile).collect()[0]
    assert (stored.year, stored.cash_type, stored.avg_gift_amt, stored.avg_up_amt) == (2025, "No_cash_donor", 10000, None)


def test_outliers_are_split_not_lost(spark):
    stored = spark.createDataFrame(
        [(2025, "ONLINE", 1000000000), (2025, "ONLINE", 9999999), (2025, "ONLINE", 5), (2024, "ONLINE", 9999999),
         (2025, None, 9999999), (2025, "ONLINE", None)],
        "year bigint, channel_g2 string, avg_gift_amt bigint")
    kept, removed = rg.rg_profile_outliers(stored, YEAR)
    assert (kept.count(), removed.count()) == (4, 2)
    assert {r.avg_gift_amt for r in removed.collect()} == {1000000000, 9999999}
