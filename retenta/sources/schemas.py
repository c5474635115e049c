"""Declared schemas of the source tables and of the stored reports."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "double": T.DoubleType(),
    "money": T.DecimalType(18, 2), "money_sum": T.DecimalType(38, 2), "whole_sum": T.DecimalType(38, 0),
}


def _struct(columns: str) -> T.StructType:
    """``name type`` pairs as a schema (StructType.fromDDL would need a running session)."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "contacts": _struct(
        "donor_no bigint, name string, contact_date date, initial_enroll string, enroll string, gender string, "
        "age int, birth_date date, payment_method string, cancel_date date, all_end_date date, "
        "cancel_route string, cancel_reason string, email_opt string, email_yn string, mail_opt string, "
        "mvd_type string, home_zip string, office_zip string, rg_amount money, tot_amt money, tot_tran bigint, "
        "first_month string, start_month string, campaign_raw string"
    ),
    "pledges": _struct(
        "pledge_uid bigint, donor_no bigint, name string, submit_date date, start_month string, start_date date, "
        "end_month string, end_date date, end_check string, all_end_date date, cancel_cal_date string, "
        "payment_method string, org string, frequency int, donation_section string, user_type1 string, "
        "user_type2 string, user_input_1 string, entered string, campaign_raw string, pledge_active string, "
        "status string, pledge_status string, rg_amount money"
    ),
    "transactions": _struct(
        "tran_uid string, pledge_uid bigint, donor_no bigint, send_date date, income_date date, tran_amount money, "
        "payment_type string, payment_method string, donation_section string, pledge_active string"
    ),
    "campaigns": _struct("campaign_raw string, campaign string"),
    "channel_gb": _struct(
        "channel_t string, acq_gb string, channel_excl_upgrade string, channel string, new_site_code_acq string"
    ),
    "classified_gifts": _struct(
        "transaction_id string, supporter_id bigint, transaction_type string, transaction_date date, "
        "campaign_id string, channel string, acq_gb_simple string, sitecode string"
    ),
    "gift_facts": _struct(
        "transaction_id string, supporter_id bigint, campaign_id string, transaction_type string, "
        "payment_method string, transaction_date date, first_month string, transaction_amount money, "
        "product string, mvd_income_auto string"
    ),
    "ltv_gifts": _struct(
        "supporter_id bigint, name string, transaction_date string, payment_type string, payment_method string, "
        "transaction_amount money, source_id string, donation_section string, first_month string"
    ),
    "ltv_channel_gb": _struct("channel_t string, channel_f string, acq_gb string"),
    "don_section": _struct("d_sec_raw string, d_sec_kor string, d_sec_eng string"),
    "zip_code_region": _struct("zip_code string, gb string, region string"),
    "income": _struct("donor_no bigint, donation_spend string, channel_raw string, donor_type string"),
    "bank_ledger": _struct(
        "gb string, spend_out double, name string, tran_method string, bank string, report_ym string"
    ),
    "change_history": _struct(
        "member_no bigint, field string, before_value string, changed_by string, changed_at timestamp"
    ),
    "cms_results": _struct(
        "member_no bigint, applied_on date, external_approval string, apply_kind string, result_kind string, "
        "amount money, result string, message string"
    ),
    "crm_contacts": _struct(
        "member_uid bigint, member_no bigint, joined_on date, join_route string, total_amount money, "
        "pay_active string, pay_end_date date"
    ),
    "case_log": _struct(
        "case_id bigint, member_uid bigint, recorded_at timestamp, category string, subcategory string, "
        "title string, body string"
    ),
    "merge_history": _struct("merge_id bigint, surviving_member_no bigint"),
    "merge_history_detail": _struct("merge_id bigint, merged_member_no bigint"),
}

# Lookup tables and the columns that must identify a row (a repeated key would multiply report rows).
LOOKUP_KEYS: dict[str, list[str]] = {
    "campaigns": ["campaign_raw"],
    "channel_gb": ["channel_t", "acq_gb"],
    "ltv_channel_gb": ["channel_t", "acq_gb"],
    "don_section": ["d_sec_raw"],
    "zip_code_region": ["zip_code", "gb"],
    "contacts": ["donor_no"],
    "transactions": ["tran_uid"],
}

REPORTS: dict[str, T.StructType] = {
    "retention_report": _struct(
        "period string, month_first date, channel_sitecode string, channel_gb string, recruit_channel string, "
        "f2f_type_street_b2b string, f2f_channel_gb string, new_donor bigint, active_donor bigint, "
        "lapsed_donor bigint, lapsed_3m bigint, lapsed_12m bigint, reactivation_donor bigint, "
        "conversion_donor bigint"
    ),
    "new_donor": _struct(
        "donor_no bigint, transaction_type string, first_transaction_date date, tran_amount bigint, "
        "payment_method string, campaign_id string, channel string, donation_section string, "
        "acq_gb_simple string, sitecode string"
    ),
    "active_donor_summary": _struct("reporting string, donor_type string, supporter_count bigint"),
    "reactivation_donor": _struct(
        "donor_no bigint, transaction_type string, reactivation_date date, rg_amount money, "
        "payment_method string, campaign_id string, channel string, donation_section string, "
        "acq_gb_simple string, sitecode string"
    ),
    "conversion_donor": _struct(
        "donor_no bigint, first_oo_transaction_date date, first_oo_campaign_id string, first_oo_channel string, "
        "first_oo_acq_gb_simple string, first_oo_sitecode string, conversion_date date, "
        "conversion_acq_gb_simple string, conversion_campaign string, conversion_amount money, "
        "conversion_donation_section string"
    ),
    "rg_profile": _struct(
        "year bigint, channel_g2 string, channel_g3 string, channel_g4 string, channel_t string, "
        "gift_band string, age_band string, gender string, region_3 string, email_opt boolean, mail_opt boolean, "
        "mvd_gb string, upgrade string, cross_sell string, life_year string, cash_type string, count bigint, "
        "tot_avg_age bigint, avg_gift_amt bigint, avg_up_amt string, avg_cash_amt string"
    ),
    "oo_profile": _struct(
        "year string, channel_s string, channel_f_wncash string, cash_donor_type_ty string, donor_type_ty string, "
        "donor_type_origin string, donor_gb string, oo_tygift_band string, rg_tygift_band string, "
        "age_band string, gender string, region_3 string, email_opt string, mail_opt string, life_year string, "
        "earmarking_eng string, count whole_sum, tot_oo_tygift money_sum, "
        "tot_oo_gift_tyfreq whole_sum, tot_avg_age bigint, oo_cy_pay_method string, "
        "oo_cy_pay_method_combined string, oo_tygift_band_order int, age_band_order int, "
        "life_year_band_order int, region_3_order int"
    ),
}
# The quarter's copy of the monthly lists has their columns.
REPORTS["quarter_new_donor"] = REPORTS["new_donor"]
