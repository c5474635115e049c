from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retenta import Period
from retenta.plans import oo_profile as oo

YEAR = Period.year(2025)


def gift(donor, day, amount=100, kind="1", method="CMS", source="A/B", section="s", first_month="2024-01"):
    return {"supporter_id": donor, "transaction_date": day, "transaction_amount": Decimal(amount), "payment_type": kind,
            "payment_method": method, "source_id": source, "donation_section": section, "first_month": first_month}


CHANNELS = [("AB", "FAB", "Acquisition"), ("AB", "FAB", "Existing"), ("EX", "FEX", "Existing")]


def lookups(table):
    channels = table("ltv_channel_gb", *[dict(zip(("channel_t", "channel_f", "acq_gb"), c)) for c in CHANNELS])
    sections = table("don_section", {"d_sec_raw": "s", "d_sec_kor": "k", "d_sec_eng": "Syria Emergency"})
    return channels, sections


def by_donor(frame, *columns, key="supporter_id"):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in frame.collect()}


def test_first_gift_of_the_year_with_life_time_amounts(table):
    gifts = table(
        "ltv_gifts", gift(1, "20250301", 300), gift(1, "20250301", 200), gift(1, "20240101", 700), gift(1, "20260101", 9),
        gift(1, "20250101", 5, method="HappyBean"), gift(1, "20250101", 5, method=None), gift(1, "20250101", 5, kind="2"),
        gift(2, "20240101"), gift(3, "20250101", source="E/X"), gift(4, "20250101", source="Q/Q"), gift(5, "20250101", source=None),
    )
    got = by_donor(oo.oo_first_gift(gifts, *lookups(table), YEAR), "transaction_amount", "ty_tot_trans_amt", "ty_oo_count", "channel_f")
    assert got == {1: (Decimal(200), Decimal(1200), 3, "FAB"), 4: (100, 100, 1, None), 5: (100, 100, 1, None)}
    row = oo.oo_first_gift(gifts, *lookups(table), YEAR).filter("supporter_id = 1").collect()[0]
    assert (row.ty_avg_trans_amt, row.d_sec_kor) == (Decimal("400"), "k")


def test_gift_order(table):
    gifts = table("ltv_gifts", gift(1, "20250301"), gift(2, "20250301"), gift(2, "20250302", kind="2"), gift(3, "20250301"),
                  gift(3, "20250301", kind="2"), gift(4, "20250301"), gift(4, "20250201", kind="2"), gift(5, "20250301", kind="2"),
                  gift(6, "20250301"), gift(6, "20240101", kind="2"), gift(7, "20250301"),
                  gift(7, "20250201", kind="2", method=None))
    assert by_donor(oo.gift_order_type(gifts, YEAR), "donor_type") == {
        1: "only_oo_donor", 2: "oo_to_rg_donor", 3: "rg_to_oo_donor", 4: "rg_to_oo_donor", 6: "only_oo_donor", 7: "rg_to_oo_donor"}
    assert by_donor(oo.cross_sell(gifts, YEAR), "donor_type_ty", key="donor_no") == {
        1: None, 2: "Cross-sell donor", 3: "Cross-sell donor", 4: "Cross-sell donor", 6: None, 7: "Cross-sell donor"}


@pytest.mark.parametrize("days", [1, 364, 365, 729, 730, 1097, 1098])
def test_gap_to_the_prior_gift(table, days):
    first = date(2025, 1, 1)
    prior = (first - timedelta(days=days)).strftime("%Y%m%d")
    gifts = table("ltv_gifts", gift(1, "20250101"), gift(1, "20250601"), gift(1, prior), gift(1, "20100101"),
                  gift(1, "20241231", method="HappyBean"), gift(1, "20241231", kind="2"), gift(2, "20250101"))
    got = by_donor(oo.prior_gift_gap(gifts, YEAR), "max_tran", "min_oo_cy_date", "duration_before_er")
    assert got == {1: (prior, "20250101", days), 2: (None, "20250101", 0)}


def test_cash_types(table):
    gifts = table(
        "ltv_gifts", gift(1, "20250301", source="Cash_DM"), gift(1, "20250302", source="Cash_SMS"), gift(2, "20250301", source="x Cash_SMS"),
        gift(3, "20250301", source="Cash_EMAIL"), gift(3, "20250401", source="Cash_EMAIL"), gift(4, "20250301", source="Cash_?"),
        gift(5, "20250301", source="A/B"), gift(6, "20240301", source="Cash_DM"), gift(6, "20250301"),
        gift(7, "20250301", source="Cash_DM"), gift(7, "20250301", source="Cash_SMS"),
    )
    assert by_donor(oo.cash_type_first(gifts, YEAR), "cash_type") == {
        1: "Cash_DM", 2: "Cash_SMS", 3: "Cash_EMAIL", 4: None, 7: "Cash_SMS"}
    got = by_donor(oo.cash_type_pivot(gifts, YEAR), "ty_cash_sms", "ty_cash_dm", "ty_cash_email", "ty_cash_multi", "cash_more")
    assert got == {1: ("cash_sms", "cash_dm", "", "", "cash_more"), 3: ("", "", "cash_email", "", ""), 4: ("", "", "", "", ""),
                   7: ("cash_sms", "cash_dm", "", "", "cash_more")}


def everything(table, *gifts, contacts=({"donor_no": 1, "age": 30, "home_zip": "11-1", "gender": "F"},)):
    zips = table("zip_code_region", {"zip_code": "11", "gb": "old_zip", "region": "서울특별시"}, {"zip_code": "11", "gb": "new_zip", "region": "강원도"})
    return (table("ltv_gifts", *gifts), table("contacts", *contacts), *lookups(table), zips, YEAR)


def test_region_join_equals_the_union_by_class(table):
    contacts = [{"donor_no": i, "home_zip": h, "office_zip": o} for i, (h, o) in enumerate(
        [("11-1", None), ("11234", None), (None, None), (None, "11-9"), ("99-1", None), ("11234", "1-1")])]
    args = everything(table, *[gift(i, "20250101") for i in range(7)], contacts=contacts)
    joined = oo.oo_donor_info(*args)
    zips = args[4]
    parts = []
    plain = joined.drop("region")
    for name in ("old_zip", "new_zip"):
        side = zips.filter(F.col("gb") == name).select(F.col("zip_code").alias("z"), "region")
        rows = plain.filter(F.col("zip_gb") == name)
        parts.append(rows.join(side, F.substring("all_zip", 1, 2) == F.col("z"), "left").drop("z"))
    union = parts[0].unionByName(parts[1]).unionByName(plain.filter("zip_gb = ''").withColumn("region", F.lit("")))
    assert sorted(map(str, joined.select(*union.columns).collect())) == sorted(map(str, union.collect()))
    assert by_donor(joined, "region", "zip_gb") == {
        0: ("서울특별시", "old_zip"), 1: ("강원도", "new_zip"), 2: ("", ""), 3: ("서울특별시", "old_zip"), 4: (None, "old_zip"),
        5: ("서울특별시", "old_zip"), 6: ("", "")}


@pytest.mark.parametrize(
    ("first_month", "life_year", "donor_gb"),
    [("2025-01", "New Active", "New"), ("2024-12", "Over 1yr", "Existing"), ("2022-01", "Over 3yrs", "Existing"),
     ("2019-05", "Over 4yrs", "Existing"), (None, "New Active", "Existing"), ("2026-02", "New Active", "Existing")],
)
def test_life_year_is_clamped(table, first_month, life_year, donor_gb):
    row = oo.oo_supporters(*everything(table, gift(1, "20250101", first_month=first_month))).collect()[0]
    assert (row.life_year, row.donor_gb) == (life_year, donor_gb)


def test_supporter_columns_and_profile(table):
    args = everything(
        table, gift(1, "20250101", 30000, method="CMS", source="A/B"), gift(1, "20240101", 10000),
        gift(1, "20250201", 100, source="Cash_SMS"), gift(1, "20250202", 100, source="Cash_DM"), gift(1, "20250103", 10001, kind="2"),
        gift(9, "20250101", method="Kakao", source="N/N", section="none"),
    )
    rows = {r.supporter_id: r for r in oo.oo_supporters(*args).collect()}
    one = rows[1]
    assert (one.oo_gift_tyvalue, one.oo_tygift_band, one.rg_gift_tyvalue, one.rg_tygift_band) == (10050, "10k~20k", 10001, "10k~20k")
    assert (one.cash_type, one.cash_type_2, one.donor_type_origin, one.donor_type_ty) == ("Cash_SMS", "Cash_MORE", "oo_to_rg_donor", "Cross-sell donor")
    assert (one.first_oo_date, one.duration_before_er, one.first_earmarking_before, one.oo_cy_pay_method_gb) == ("20240101", "1yr", "SYR ER", "CMS")
    nine = rows[9]
    assert (nine.age_band, nine.email_opt, nine.region_3, nine.oo_cy_pay_method_gb, nine.first_earmarking_before) == (
        "No data", "Y", "No data", "Others", "General")
    profile = oo.oo_profile(*args)
    assert len(profile.columns) == 22
    assert sum(r["count"] for r in profile.collect()) == 2
    stored = oo.oo_profile_rows(profile, YEAR)
    assert len(stored.columns) == 26
    assert {(r.oo_tygift_band_order, r.age_band_order, r.region_3_order, r.oo_cy_pay_method_combined) for r in stored.collect()} == {
        (2, 3, 1, "CMS"), (1, 8, 4, "Others")}
