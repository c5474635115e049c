"""The registered queries: one per job, over the stand-in tables, plus one per group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from retenta import Period
from retenta.functions import (
    band, channel_key, first_of_month_text, month_diff, month_start, part_from_right, rank_map, whole_number,
    whole_years_between, zip_class,
)
from retenta.operators import RunFolder, duplicate_keys, follow_merges
from retenta.plans import commitments as com
from retenta.plans import distinct_rollup, gift_gaps, history
from retenta.plans import lists
from retenta.plans import monthly as mon
from retenta.plans import oo_profile as oo
from retenta.plans import retention as ret
from retenta.plans import rg_profile as rg
from retenta.plans.profiles import region_columns
from retenta.rule_tables import rule_usage as usage_of
from retenta.sources import REPORTS, TABLES, MonthlyTable
from retenta.sources.gift_states import GiftStates
from retenta.vocab import (
    AGE_ORDER, CROSS_SELL_BANDS, NO_DATA, OO_AGE_BANDS, OO_VALUE_BANDS, OO_VALUE_ORDER, RG_GIFT_BANDS, TENURE_QUARTER_BANDS,
)

from . import periods as p
from .standin import StandIns

Query = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Callable[[StandIns], DataFrame]] = {}


def _job(fn: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    JOBS[fn.__name__] = fn
    return fn


def presented(df: DataFrame) -> DataFrame:
    """Decimals shown as doubles, the type in which both engines print them alike."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _stage(t: StandIns) -> RunFolder:
    """Short lists and dealt rows are stored, as in the workflows."""
    return RunFolder.of_session(t["contacts"].sparkSession)


def _query(job: Callable[[StandIns], DataFrame]) -> Query:
    return lambda spark, sf_dir: presented(job(StandIns(spark, sf_dir)))


def registered() -> dict[str, Query]:
    return {name: _query(job) for name, job in JOBS.items()}


# --- monthly retention report -------------------------------------------------------------------------


@_job
def dq_missing_campaign(t):
    return com.missing_campaign(t["pledges"], p.MONTH)


@_job
def dq_inhouse_unmarked(t):
    return com.inhouse_unmarked(t["pledges"], p.MONTH)


@_job
def commitment_view(t):
    return com.commitment_view(
        t["pledges"], t["transactions"], t["contacts"], t["campaigns"], p.AS_OF, p.LOADED_AT
    )


@_job
def commitment_view_by_months(t):
    """The view from stored states: built while a month's gifts had not come and another's were wrong, then refreshed."""
    gifts, wrong = t["transactions"], Period.month(1998, 5)
    early = gifts.filter(~F.coalesce(p.MONTH.holds(F.col("send_date")), F.lit(False))).withColumn(
        "tran_amount", F.when(wrong.holds(F.col("send_date")), F.lit(1).cast("decimal(18,2)")).otherwise(F.col("tran_amount")))
    states = GiftStates(gifts.sparkSession, _stage(t).path)
    states.build(early)
    states.refresh(gifts, [p.MONTH, wrong])
    return com.commitment_view_of(t["pledges"], com.extremes_of(states.state(gifts)), t["contacts"], t["campaigns"], p.AS_OF, p.LOADED_AT)


def _classified(t):
    return com.classified_pledges(com.commitment_core(t["pledges"], t["contacts"]), t["channel_gb"])


@_job
def pledge_base(t):
    return com.pledge_base(com.commitment_core(t["pledges"], t["contacts"]), t["channel_gb"], stage=_stage(t))


def _flags(t):
    return ret.donor_flags(_classified(t), p.MONTH)


@_job
def donor_flags(t):
    return _flags(t).select(
        "commitment_id", "supporter_id", "name", "channel", "acq_gb", "new_site_code_acq", "channel_gb", "cancel_status",
        "commitment_month", "active_donor", "new_donor", "reactivation", "conversion", "review_month",
    )


def _cancelled(t):
    return ret.cancelled_contacts(t["contacts"], p.MONTH)


@_job
def cancelled_contacts(t):
    return _cancelled(t)


@_job
def cancelled_pledges(t):
    return ret.cancelled_pledges(t["pledges"], _cancelled(t), stage=_stage(t))


def _lapsed(t):
    return ret.lapsed_donors(t["pledges"], _cancelled(t), t["channel_gb"])


@_job
def lapsed_donors(t):
    return _lapsed(t)


@_job
def lapsed_flags(t):
    return ret.lapsed_flags(_lapsed(t), p.MONTH)


@_job
def dash_donor(t):
    return ret.dash_donor(_flags(t))


@_job
def dash_lapsed(t):
    return ret.dash_lapsed(ret.lapsed_flags(_lapsed(t), p.MONTH))


@_job
def donor_retention_summary(t):
    return ret.donor_retention_summary(t["pledges"], t["contacts"], t["channel_gb"], p.MONTH)


@_job
def donor_retention_summary_filled(t):
    """The option that gives lapsed-only rows their period."""
    return ret.donor_retention_summary(t["pledges"], t["contacts"], t["channel_gb"], p.MONTH, coalesce_period=True)


@_job
def retention_history(t):
    return history.retention_history(t["pledges"], t["contacts"], t["channel_gb"], p.HISTORY)


@_job
def flag_crosstab(t):
    return ret.flag_crosstab(_flags(t), ret.lapsed_flags(_lapsed(t), p.MONTH))


# --- donor lists --------------------------------------------------------------------------------------


@_job
def new_donor_month(t):
    return lists.new_donor_month(t["classified_gifts"], t["transactions"], p.MONTH, stage=_stage(t))


@_job
def new_donor_month_prefix_rule(t):
    """The option that leaves out all ``2.`` site codes."""
    return lists.new_donor_month(t["classified_gifts"], t["transactions"], p.MONTH, site_code_prefix_rule=True, stage=_stage(t))


@_job
def active_donor_summary(t):
    return lists.active_donor_summary(t["gift_facts"], t["contacts"], p.TRAILING, p.QUARTER.label)


def _new_quarter(t):
    return lists.new_donor_quarter(t["classified_gifts"], t["transactions"], p.YTD, stage=_stage(t))


@_job
def new_donor_quarter(t):
    return _new_quarter(t)


@_job
def new_donor_list(t):
    return lists.read_out(_new_quarter(t), "first_transaction_date", p.HALF)


@_job
def append_new_donor(t):
    columns = REPORTS["new_donor"].fieldNames()
    return lists.quarter_slice(_new_quarter(t), "first_transaction_date", p.QUARTER, columns)


@_job
def reactivation_list(t):
    return lists.reactivation_list(t["classified_gifts"], t["transactions"], p.QUARTER, stage=_stage(t))


@_job
def reactivation_readout(t):
    listed = lists.reactivation_list(t["classified_gifts"], t["transactions"], p.YEAR, stage=_stage(t))
    return lists.read_out(listed, "reactivation_date", p.HALF)


def _conversions(t, period):
    return lists.conversion_list(t["classified_gifts"], t["transactions"], period, stage=_stage(t))


@_job
def conversion_list(t):
    return _conversions(t, p.QUARTER)


@_job
def conversion_readout(t):
    return lists.read_out(_conversions(t, p.YEAR), "conversion_date", p.HALF)


@_job
def conversion_in_new_donor(t):
    return lists.conversion_in_new_donor(_conversions(t, p.HALF), _new_quarter(t), p.HALF)


@_job
def merged_members(t):
    return lists.merged_members(t["merge_history"], t["merge_history_detail"])


@_job
def resolve_merged_donors(t):
    new = lists.new_donor_month(t["classified_gifts"], t["transactions"], p.MONTH, stage=_stage(t))
    checked = lists.conversion_in_new_donor(_conversions(t, p.HALF), new, p.HALF)
    return lists.resolve_merged_donors(checked, t["merge_history"], t["merge_history_detail"], new)


@_job
def merge_survivors(t):
    links = lists.merged_members(t["merge_history"], t["merge_history_detail"])
    _stage(t)
    return follow_merges(links)


@_job
def resolve_merged_donors_chained(t):
    """The option that follows merges over several steps."""
    new = lists.new_donor_month(t["classified_gifts"], t["transactions"], p.MONTH, stage=_stage(t))
    checked = lists.conversion_in_new_donor(_conversions(t, p.HALF), new, p.HALF)
    return lists.resolve_merged_donors(
        checked, t["merge_history"], t["merge_history_detail"], new, through_chains=True
    )


# --- profile of regular givers ------------------------------------------------------------------------


def _rg_base(t):
    return rg.rg_active_base(t["pledges"], p.YEAR)


@_job
def rg_active_base(t):
    return _rg_base(t)


def _rg_info(t):
    return rg.rg_donor_info(_rg_base(t), t["contacts"], t["channel_gb"], p.YEAR)


@_job
def rg_donor_info(t):
    return _rg_info(t)


def _rg_addons(t):
    return rg.rg_addons(_rg_info(t), t["income"], t["zip_code_region"])


@_job
def rg_addons(t):
    return _rg_addons(t)


@_job
def rg_profile(t):
    return rg.rg_profile(_rg_addons(t), p.YEAR)


def _rg_rows(t):
    return rg.rg_profile_rows(rg.rg_profile(_rg_addons(t), p.YEAR))


@_job
def rg_profile_append(t):
    return _rg_rows(t)


RG_REMOVED = [{"channel_g2": "ONLINE", "age_band": "No data"}, {"channel_g2": "DRTV", "gender": "F", "mvd_gb": "MVD"}]


@_job
def rg_profile_outliers(t):
    return rg.rg_profile_outliers(_rg_rows(t), p.YEAR, RG_REMOVED)[1]


@_job
def rg_profile_kept(t):
    return rg.rg_profile_outliers(_rg_rows(t), p.YEAR, RG_REMOVED)[0]


@_job
def income_control_totals(t):
    """Distinct donors and rounded mean of the uploaded income file."""
    return rg.income_control_totals(t["income"])


# --- profile of one-off givers ------------------------------------------------------------------------


def _oo_tables(t):
    return t["ltv_gifts"], t["contacts"], t["ltv_channel_gb"], t["don_section"], t["zip_code_region"], p.YEAR


@_job
def oo_first_gift(t):
    return oo.oo_first_gift(t["ltv_gifts"], t["ltv_channel_gb"], t["don_section"], p.YEAR).withColumn(
        "ty_avg_trans_amt", F.round("ty_avg_trans_amt", 2)
    )


@_job
def oo_donor_info(t):
    return oo.oo_donor_info(*_oo_tables(t)).withColumn("ty_avg_trans_amt", F.round("ty_avg_trans_amt", 2))


@_job
def gift_order_type(t):
    return oo.gift_order_type(t["ltv_gifts"], p.YEAR)


@_job
def prior_gift_gap(t):
    return oo.prior_gift_gap(t["ltv_gifts"], p.YEAR)


@_job
def prior_gift_of_every_gift(t):
    return gift_gaps.prior_gift_of_every_gift(t["transactions"], _stage(t))


@_job
def cross_sell(t):
    return oo.cross_sell(t["ltv_gifts"], p.YEAR)


@_job
def cash_type_first(t):
    return oo.cash_type_first(t["ltv_gifts"], p.YEAR)


@_job
def cash_type_pivot(t):
    return oo.cash_type_pivot(t["ltv_gifts"], p.YEAR)


@_job
def oo_profile(t):
    return oo.oo_profile(*_oo_tables(t))


@_job
def oo_profile_append(t):
    return oo.oo_profile_rows(oo.oo_profile(*_oo_tables(t)), p.YEAR)


# --- monthly counts -----------------------------------------------------------------------------------


@_job
def oneoff_headcount(t):
    return mon.oneoff_headcount(t["transactions"], p.MONTH)


@_job
def oneoff_by_section(t):
    return mon.oneoff_by_section(t["transactions"], p.MONTH)


def _gifts_by_month(t: StandIns) -> MonthlyTable:
    """All gifts, stored by month; one quarter is stored again, as after corrections, and must stand there once."""
    gifts = t["transactions"]
    stored = MonthlyTable(gifts.sparkSession, f"{_stage(t).path}/gifts", TABLES["transactions"], "send_date")
    stored.build(gifts)
    stored.refresh(gifts, p.QUARTER.months())
    return stored


@_job
def oneoff_by_section_stored(t):
    """From the files of the month only."""
    return mon.oneoff_by_section(_gifts_by_month(t).during(p.MONTH), p.MONTH)


@_job
def gifts_stored_by_month(t):
    """Gifts of a month and of a half year by month, and of the whole table."""
    stored, counts = _gifts_by_month(t), (F.count(F.lit(1)).alias("gifts"), F.countDistinct("donor_no").alias("donors"), F.sum("tran_amount").alias("amount"))
    month = F.date_format("send_date", "yyyy-MM").alias("gift_month")
    some = stored.during(p.MONTH, Period.half(1997, 1)).groupBy(month).agg(*counts)
    return some.unionByName(stored.rows().agg(*counts).withColumn("gift_month", F.lit("all")))


@_job
def oneoff_rollup(t):
    bitmaps = _stage(t)(distinct_rollup.donor_bitmaps(t["transactions"], p.YEAR))
    return distinct_rollup.oneoff_rollup(bitmaps)


@_job
def email_subscribers(t):
    return mon.email_subscribers(t["contacts"], p.MONTH)


@_job
def internal_cancel_by_route(t):
    return mon.internal_cancel_by_route(t["contacts"], t["pledges"], t["channel_gb"], p.MONTH)


@_job
def external_cancel_by_route(t):
    return mon.external_cancel_by_route(t["change_history"], t["cms_results"], t["crm_contacts"], p.LEDGER_MONTH)


@_job
def bank_income_class(t):
    return mon.bank_income_class(t["bank_ledger"], p.LEDGER_MONTH)


@_job
def anonymous_oneoff(t):
    return mon.anonymous_oneoff(t["bank_ledger"], t["transactions"], p.LEDGER_MONTH, p.MONTH)


@_job
def refund_list(t):
    return mon.refund_list(t["case_log"], t["crm_contacts"], p.MONTH)


@_job
def refund_list_whole_last_day(t):
    """The option that takes the month's last day in full."""
    return mon.refund_list(t["case_log"], t["crm_contacts"], p.MONTH, whole_last_day=True)


# --- functions and rule tables over whole tables ------------------------------------------------------


@_job
def rg_channel_groups(t):
    """All four groupings of the channels of regular pledges."""
    channels = com.existing_channels(t["channel_gb"]).select(F.col("channel_t").alias("_key"), "channel_excl_upgrade")
    pledges = t["pledges"].select(channel_key(F.col("campaign_raw")).alias("_channel"))
    named = pledges.join(channels, F.col("_channel") == F.col("_key"), "left").select(
        F.col("channel_excl_upgrade").alias("channel_t")
    )
    keys = ["channel_t", "channel_g1", "channel_g2", "channel_g3", "channel_g4"]
    return rg.rg_channel_groups(named).groupBy(*keys).agg(F.count(F.lit(1)).alias("pledges"))


@_job
def oo_channel_groups(t):
    """All three groupings of the channels of life-time gifts."""
    known = oo.with_oo_channel(t["ltv_gifts"].select("source_id"), t["ltv_channel_gb"])
    keys = ["channel_t", "channel_f", "channel_gb1", "channel_gb2", "channel_gb3"]
    return oo.oo_channel_groups(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("gifts"))


@_job
def amount_bands(t):
    """Gift amounts through every amount band, in the scale each band is made for."""
    amount = F.col("tran_amount")
    bands = {
        "rg_band": band(whole_number(amount / 2), RG_GIFT_BANDS, NO_DATA),
        "oo_band": band(amount, OO_VALUE_BANDS, NO_DATA),
        "cross_sell_band": band(amount / 2, CROSS_SELL_BANDS, "rg_only_donor"),
    }
    return (
        t["transactions"].select(*[c.alias(n) for n, c in bands.items()])
        .withColumn("oo_order", rank_map(F.col("oo_band"), OO_VALUE_ORDER))
        .groupBy("rg_band", "oo_band", "cross_sell_band", "oo_order")
        .agg(F.count(F.lit(1)).alias("gifts"))
    )


@_job
def donor_bands(t):
    """Contacts by age band and order, tenure band and zip class."""
    return (
        t["contacts"].select(
            band(F.col("age"), OO_AGE_BANDS, NO_DATA).alias("age_band"),
            band(month_diff(F.col("cancel_date"), F.col("contact_date")), TENURE_QUARTER_BANDS, "").alias("tenure_band"),
            zip_class(F.col("home_zip"), F.col("office_zip")).alias("zip_gb"),
        )
        .withColumn("age_order", rank_map(F.col("age_band"), AGE_ORDER))
        .groupBy("age_band", "age_order", "tenure_band", "zip_gb")
        .agg(F.count(F.lit(1)).alias("donors"))
    )


@_job
def calendar_fields(t):
    """Date functions over all pledges."""
    signed, month = F.col("submit_date"), F.col("end_month")
    return t["pledges"].select(
        "pledge_uid",
        month_start(signed).alias("signed_month"),
        month_diff(first_of_month_text(month), signed).alias("months_to_end"),
        whole_years_between(first_of_month_text(month), signed).alias("years_to_end"),
        F.datediff(F.to_date("cancel_cal_date", "yyyy-MM-dd"), signed).alias("days_to_cancel"),
        F.add_months(signed, -13).alias("thirteen_months_before"),
        F.date_add(signed, 365).alias("grace_end"),
        F.date_format(signed, "yyMM").alias("yymm"),
        F.year(signed).alias("year"), F.month(signed).alias("month"),
        signed.cast("timestamp").alias("signed_at"),
    )


@_job
def text_fields(t):
    """Text functions over all pledges and case titles of whole documents."""
    cases = t["case_log"].select(
        F.col("case_id").alias("id"), F.lit("case").alias("kind"),
        part_from_right(F.col("title"), 3).alias("first"), part_from_right(F.col("title"), 1).alias("second"),
        F.length("body").cast("bigint").alias("size"),
    )
    campaign = F.col("campaign_raw")
    pledges = t["pledges"].select(
        F.col("pledge_uid").alias("id"), F.lit("pledge").alias("kind"),
        channel_key(campaign).alias("first"),
        F.lower(F.replace(campaign, F.lit("/"), F.lit(""))).alias("second"),
        F.length(F.lpad(F.substring(campaign, 1, 3), 5, "0")).cast("bigint").alias("size"),
    )
    return cases.unionByName(pledges)


@_job
def region_classes(t):
    """Contacts by cleaned, grouped and classed region of their home code."""
    zips = t["zip_code_region"].select(F.col("zip_code").alias("_zip"), F.col("gb").alias("_gb"), "region")
    coded = t["contacts"].select(
        F.substring("home_zip", 1, 2).alias("_prefix"), zip_class(F.col("home_zip"), F.col("office_zip")).alias("zip_gb")
    )
    joined = coded.join(zips, (F.col("_prefix") == F.col("_zip")) & (F.col("zip_gb") == F.col("_gb")), "left")
    return region_columns(joined).groupBy("region_1", "region_2", "region_3").agg(F.count(F.lit(1)).alias("donors"))


@_job
def same_day_gifts(t):
    """The duplicate-key check, on supporter and day of all classified gifts."""
    return duplicate_keys(t["classified_gifts"], ["supporter_id", "transaction_date"])


@_job
def rule_usage(t):
    """What each rule of four ladders takes: of the cancelled donors, of all contacts, and of the gifts' halves."""
    gifts = t["transactions"].select((F.col("tran_amount") / 2).alias("half"))
    return (
        usage_of(_cancelled(t), "cancel_route")
        .unionByName(usage_of(t["contacts"], "enrol_type"))
        .unionByName(usage_of(t["contacts"], "oo_age_bands", value="age"))
        .unionByName(usage_of(gifts, "cross_sell_bands", value="half"))
    )
