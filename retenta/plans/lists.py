"""Monthly and quarterly donor lists, their read-outs and cross-checks.

The lists join a few first gifts to the whole gift table. ``stage`` may be given a function that stores
that short list and reads it back (``operators.staged``): knowing its size, Spark then streams the gifts
past it instead of shuffling them all. A list too long for that sieves the gifts where they are read, so that few
more than its own are shuffled. Without it the jobs stay lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import one_of_like, whole_number
from ..operators import Stage, as_is, first_per_key, follow_merges, sieved, with_membership
from ..period import Period
from ..vocab import DEFAULT_VOCABULARY, SITE_CODE_LITERAL, Vocabulary

GIFT_ORDER = ("transaction_date", "transaction_id")


def _site_code_rule(prefix_rule: bool) -> Column:
    """By default only the literal code (and NULL) is left out; ``prefix_rule`` leaves out all ``2.`` codes."""
    site = F.col("sitecode")
    return ~site.like(SITE_CODE_LITERAL) if prefix_rule else site != SITE_CODE_LITERAL


def _paid(first: DataFrame, transactions: DataFrame, stage: Stage) -> DataFrame:
    """The gifts to look the first gifts up in; less most of the others if the list is stored."""
    return transactions if stage is as_is else sieved(transactions, "tran_uid", first.select("transaction_id"))


def _new_donors(
    gifts: DataFrame, transactions: DataFrame, ytd: Period, shown: Period, excluded: Sequence[str], prefix_rule: bool,
    stage: Stage, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    campaign = F.col("campaign_id")
    kept = ~one_of_like(F.lower(campaign), vocab.list_excluded_campaigns_any_case)
    if excluded:
        kept = kept & ~one_of_like(campaign, excluded)
    acquired = gifts.filter(
        ytd.holds(F.col("transaction_date"))
        & (F.col("acq_gb_simple") == "Acquisition")
        & _site_code_rule(prefix_rule)
        & kept
    )
    # Who is new is settled over the year to date; the shown period is cut after that.
    first = stage(first_per_key(acquired, ["supporter_id"], GIFT_ORDER).filter(shown.holds(F.col("transaction_date"))))
    paid = _paid(first, transactions, stage).select(F.col("tran_uid").alias("_tran"), "tran_amount", "payment_method", "donation_section")
    return first.join(paid, F.col("transaction_id") == F.col("_tran")).select(
        F.col("supporter_id").alias("donor_no"),
        "transaction_type",
        F.col("transaction_date").alias("first_transaction_date"),
        whole_number(F.col("tran_amount")).alias("tran_amount"),
        "payment_method", "campaign_id", "channel", "donation_section", "acq_gb_simple", "sitecode",
    )


def new_donor_month(
    gifts: DataFrame, transactions: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY,
    site_code_prefix_rule: bool = False, stage: Stage = as_is,
) -> DataFrame:
    """Donors whose first acquisition gift of the year falls in the month."""
    ytd = Period.ytd(month.start.year, month.start.month)
    return _new_donors(
        gifts, transactions, ytd, month, vocab.monthly_list_excluded_campaigns, site_code_prefix_rule, stage, vocab=vocab
    )


def new_donor_quarter(
    gifts: DataFrame, transactions: DataFrame, ytd: Period, site_code_prefix_rule: bool = False, stage: Stage = as_is, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """New donors of the year to date, drawn afresh at quarter end: fewer campaigns are left out."""
    return _new_donors(gifts, transactions, ytd, ytd, (), site_code_prefix_rule, stage, vocab=vocab)


def active_donor_summary(gift_facts: DataFrame, contacts: DataFrame, window: Period, label: str) -> DataFrame:
    """Donors who gave in the window, counted as regular givers still active or pure one-off givers.

    A regular giver counts if not ended, or ended outside the window (also before it).
    """
    givers = (
        gift_facts.filter(window.holds(F.col("transaction_date")))
        .groupBy("supporter_id")
        .agg(F.coalesce(F.max(F.col("transaction_type") == "Regular"), F.lit(False)).alias("_regular"))
    )
    ends = contacts.select(F.col("donor_no").alias("supporter_id"), "all_end_date")
    counted = ~F.col("_regular") | F.col("all_end_date").isNull() | ~window.holds(F.col("all_end_date"))
    return (
        givers.join(ends, "supporter_id")
        .filter(counted)
        .groupBy(F.when(F.col("_regular"), "RG").otherwise("Pure OO").alias("donor_type"))
        .agg(F.count("supporter_id").alias("supporter_count"))
        .select(F.lit(label).alias("reporting"), "donor_type", "supporter_count")
    )


def read_out(report: DataFrame, date_column: str, period: Period) -> DataFrame:
    """A stored list for a period, in date order.

    Donor numbers settle the order within a day, and let the sort spread a crowded day over many tasks.
    """
    return report.filter(period.holds(F.col(date_column))).orderBy(date_column, "donor_no")


def quarter_slice(report: DataFrame, date_column: str, quarter: Period, columns: Sequence[str]) -> DataFrame:
    """The rows of a stored list that a quarterly append takes, in the target's columns."""
    return report.filter(quarter.holds(F.col(date_column))).select(*columns)


def reactivation_list(
    gifts: DataFrame, transactions: DataFrame, quarter: Period, stage: Stage = as_is, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Existing donors' first gift per reactivation campaign, if it falls in the quarter."""
    reactivated = gifts.filter(
        one_of_like(F.col("campaign_id"), vocab.reactivation_campaigns) & (F.col("acq_gb_simple") == "Existing")
    )
    first = stage(first_per_key(reactivated, ["supporter_id", "campaign_id"], GIFT_ORDER).filter(
        quarter.holds(F.col("transaction_date"))
    ))
    paid = _paid(first, transactions, stage).select(F.col("tran_uid").alias("_tran"), "tran_amount", "payment_method", "donation_section")
    return first.join(paid, F.col("transaction_id") == F.col("_tran")).select(
        F.col("supporter_id").alias("donor_no"),
        "transaction_type",
        F.col("transaction_date").alias("reactivation_date"),
        F.col("tran_amount").alias("rg_amount"),
        "payment_method", "campaign_id", "channel", "donation_section", "acq_gb_simple", "sitecode",
    )


def conversion_list(
    gifts: DataFrame, transactions: DataFrame, quarter: Period, stage: Stage = as_is, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Donors' first gift per conversion campaign in the quarter, beside their first one-off gift ever."""
    converted = stage(first_per_key(
        gifts.filter(one_of_like(F.col("campaign_id"), vocab.conversion_campaigns)), ["supporter_id", "campaign_id"], GIFT_ORDER
    ).filter(quarter.holds(F.col("transaction_date"))))
    first_single = first_per_key(
        gifts.filter(F.col("transaction_type") == "Single").join(converted.select("supporter_id"), "supporter_id", "left_semi"),
        ["supporter_id"], GIFT_ORDER,
    ).select(
        F.col("supporter_id").alias("_supporter"),
        F.col("transaction_date").alias("first_oo_transaction_date"),
        F.col("campaign_id").alias("first_oo_campaign_id"),
        F.col("channel").alias("first_oo_channel"),
        F.col("acq_gb_simple").alias("first_oo_acq_gb_simple"),
        F.col("sitecode").alias("first_oo_sitecode"),
    )
    paid = _paid(converted, transactions, stage).select(
        F.col("tran_uid").alias("_tran"),
        F.col("tran_amount").alias("conversion_amount"),
        F.col("donation_section").alias("conversion_donation_section"),
    )
    return (
        converted.join(paid, F.col("transaction_id") == F.col("_tran"))
        .join(first_single, F.col("supporter_id") == F.col("_supporter"), "left")
        .select(
            F.col("supporter_id").alias("donor_no"),
            "first_oo_transaction_date", "first_oo_campaign_id", "first_oo_channel", "first_oo_acq_gb_simple",
            "first_oo_sitecode",
            F.col("transaction_date").alias("conversion_date"),
            F.col("acq_gb_simple").alias("conversion_acq_gb_simple"),
            F.col("campaign_id").alias("conversion_campaign"),
            "conversion_amount", "conversion_donation_section",
        )
        .orderBy("conversion_date", "donor_no", "conversion_campaign")
    )


def conversion_in_new_donor(conversions: DataFrame, new_donors: DataFrame, half_year: Period) -> DataFrame:
    """Acquired conversions of the half-year, marked Y if they stand in the new-donor list, else N."""
    acquired = conversions.filter(
        half_year.holds(F.col("conversion_date")) & (F.col("conversion_acq_gb_simple") == "Acquisition")
    )
    return with_membership(acquired, new_donors, "donor_no", "donor_no", "in_new_donor")


def merged_members(header: DataFrame, detail: DataFrame) -> DataFrame:
    """Each merged member number beside the number it was merged into."""
    return header.join(detail, "merge_id").select("surviving_member_no", "merged_member_no")


def resolve_merged_donors(
    checked: DataFrame, header: DataFrame, detail: DataFrame, new_donors: DataFrame, through_chains: bool = False,
    stage: Stage = as_is,
) -> DataFrame:
    """Former numbers of conversions missing from the new-donor list, marked if listed under one.

    ``through_chains`` also finds numbers merged over several steps (needs a checkpoint folder).
    """
    links = merged_members(header, detail)
    if through_chains:
        links = follow_merges(links)
    missing = stage(checked.filter(F.col("in_new_donor") == "N").select(
        F.col("donor_no").alias("surviving_member_no")
    ).distinct())
    # Inner and anti join instead of one left join: an often merged member sits on the side that adaptive
    # execution can split only in an inner join.
    never_merged = missing.join(links.select("surviving_member_no").distinct(), "surviving_member_no", "left_anti")
    former = links.join(missing, "surviving_member_no").select("surviving_member_no", "merged_member_no").unionByName(
        never_merged.withColumn("merged_member_no", F.lit(None).cast("bigint"))
    )
    return with_membership(former, new_donors, "merged_member_no", "donor_no", "listed_under_merged_no")
