"""Monthly counts and lists: one-off donors, e-mail subscribers, cancellations, bank income, refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, part_from_right
from ..period import Period
from ..vocab import BANK_TRANSFER, DEFAULT_VOCABULARY, ONE_OFF, Vocabulary
from .retention import cancelled_contacts, lapsed_donors


_OTHER_ROUTE = "Bank"


def oneoff_gifts(transactions: DataFrame, month: Period) -> DataFrame:
    return transactions.filter(
        (F.col("payment_type") == ONE_OFF) & (F.col("pledge_active") == "N") & month.holds(F.col("send_date"))
    )


def oneoff_headcount(transactions: DataFrame, month: Period) -> DataFrame:
    """Distinct one-off donors of the month."""
    return oneoff_gifts(transactions, month).agg(F.countDistinct("donor_no").alias("oo_donor"))


def oneoff_by_section(transactions: DataFrame, month: Period) -> DataFrame:
    """The same per donation section, largest first."""
    return (
        oneoff_gifts(transactions, month)
        .groupBy("donation_section")
        .agg(F.countDistinct("donor_no").alias("oo_donor"))
        .orderBy(F.desc("oo_donor"))
    )


def email_subscribers(contacts: DataFrame, month: Period) -> DataFrame:
    """Contacts made up to the month's end that take e-mail."""
    return contacts.filter(
        (F.col("contact_date") < F.lit(month.end_exclusive)) & (F.col("email_opt") == "Y") & (F.col("email_yn") == "Y")
    ).agg(F.count(F.lit(1)).alias("subscribers"))


def internal_cancel_by_route(
    contacts: DataFrame, pledges: DataFrame, channels: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """The month's lapsed donors by cancellation route."""
    lapsed = lapsed_donors(pledges, cancelled_contacts(contacts, month, vocab), channels, vocab)
    return lapsed.groupBy("cancel_route_eng").agg(F.count(F.lit(1)).alias("count"))


def external_cancel_by_route(
    change_history: DataFrame, cms_results: DataFrame, crm_contacts: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Members the collector switched off in the month, by termination route and last paid month.

    A member with several termination results counts once for each; those are counted per member first,
    so that one member's many records are never gathered.
    """
    # Field, writer and result codes of the collector's records.
    switched = change_history.filter(
        (F.col("field") == "납부여부")
        & (F.col("before_value") == "Y")
        & (F.col("changed_by") == "SCMS")
        & month.holds(F.col("changed_at"))
    ).select("member_no")
    # The collector books applications one day early.
    ended = (
        cms_results.filter(
            month.shifted(-1).holds(F.col("applied_on"))
            & (F.col("external_approval") == "Y")
            & (F.col("apply_kind") == "해지")
        )
        .groupBy("member_no", classify(vocab.collector_route, otherwise=_OTHER_ROUTE).alias("_route"))
        .agg(F.count(F.lit(1)).alias("_results"))
    )
    members = crm_contacts.filter(F.col("pay_active") == "N").select("member_no", "pay_end_date")
    return (
        members.join(switched, "member_no", "left_semi")
        .join(ended, "member_no", "left")
        .groupBy(
            F.coalesce("_route", F.lit(_OTHER_ROUTE)).alias("route"),
            F.date_format("pay_end_date", "yyyy-MM").alias("pay_end_month"),
        )
        .agg(F.sum(F.coalesce("_results", F.lit(1))).alias("count"))
        .orderBy("route", "pay_end_month")
    )


def _income_class(vocab: Vocabulary) -> Column:
    return classify(vocab.bank_ledger, otherwise="")


def bank_income_class(ledger: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """The month's bank-ledger rows per income class; '' is unclassified."""
    return (
        ledger.filter(F.col("report_ym") == month.yymm)
        .groupBy(_income_class(vocab).alias("income_gb"))
        .agg(F.count(F.lit(1)).alias("donor_num"))
    )


def anonymous_oneoff(
    ledger: DataFrame, transactions: DataFrame, month: Period, gift_month: Period | None = None,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Unclassified ledger rows less the bank transfers already entered as gifts.

    Each side is one row of counts; the two rows are stacked and added, which needs no join.
    """
    unclassified = ledger.filter((F.col("report_ym") == month.yymm) & (_income_class(vocab) == "")).agg(
        F.count(F.lit(1)).alias("unclassified"), F.lit(0).cast("bigint").alias("bank_transfers")
    )
    entered = transactions.filter(
        (F.col("payment_method") == BANK_TRANSFER) & (gift_month or month).holds(F.col("income_date"))
    ).agg(F.lit(0).cast("bigint").alias("unclassified"), F.count("donor_no").alias("bank_transfers"))
    return (
        unclassified.unionByName(entered)
        .agg(F.sum("unclassified").alias("unclassified"), F.sum("bank_transfers").alias("bank_transfers"))
        .withColumn("anonymous", F.col("unclassified") - F.col("bank_transfers"))
    )


def refund_list(
    case_log: DataFrame, crm_contacts: DataFrame, month: Period, whole_last_day: bool = False
) -> DataFrame:
    """Refunds completed in the month with method, amount and reason read from the case title.

    By default the range ends at midnight of the last day, as a date range over a time column does;
    ``whole_last_day`` takes that day in full.
    """
    at = F.col("recorded_at")
    if whole_last_day:
        in_month = month.holds(at)
    else:
        in_month = (at >= F.lit(month.start)) & (at <= F.lit(month.last_day))
    # Case category and state of a completed refund.
    refunds = case_log.filter(in_month & (F.col("category") == "환불") & (F.col("subcategory") == "환불완료"))
    title = F.col("title")
    return (
        refunds.join(crm_contacts, "member_uid")
        .select(
            "member_no", "joined_on", "join_route", "total_amount", "recorded_at",
            part_from_right(title, 3).alias("refund_method"),
            part_from_right(title, 2).alias("refund_amount"),
            part_from_right(title, 1).alias("refund_reason"),
            "body", "case_id",
        )
        .orderBy("recorded_at", "case_id")
        .drop("case_id")
    )
