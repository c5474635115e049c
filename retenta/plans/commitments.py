"""Pledge checks, the commitment view and the pledge base of the monthly report."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import channel_key, classify, matches_any, one_of_like
from ..operators import Stage, ordinal, with_lookup
from ..period import Period
from ..vocab import DEFAULT_VOCABULARY, ONE_OFF, Vocabulary


def missing_campaign(pledges: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """The month's pledges without a campaign, test names left out."""
    real_name = reduce(lambda a, b: a & b, [~F.col("name").like(p) for p in vocab.check_excluded_names])
    return pledges.filter(month.holds(F.col("submit_date")) & F.col("campaign_raw").isNull() & real_name)


def inhouse_unmarked(pledges: DataFrame, month: Period) -> DataFrame:
    """The month's in-house face-to-face pledges that are not marked as reactivations."""
    campaign = F.col("campaign_raw")
    return pledges.filter(
        month.holds(F.col("submit_date"))
        & F.replace(campaign, F.lit("/"), F.lit("")).like("F2FIH%")
        & ~campaign.like("%Reactivation%")
    )


def commitment_core(pledges: DataFrame, contacts: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Pledge and donor columns of the commitment view, one-off pledges left out."""
    frequency = (
        F.when(F.col("frequency") == 1, "Monthly")
        .when(F.col("frequency") == 12, "Annual")
        .when(F.col("frequency").isNull(), "check")
        .otherwise("Other")
    )
    donors = contacts.select(
        F.col("donor_no").alias("_donor"),
        "name",
        F.col("cancel_date").alias("cancel_date_contact_level"),
        F.col("all_end_date").alias("all_end_date_contact_level"),
        F.col("payment_method").alias("payment_method_contact_level"),
        F.col("cancel_route").alias("cancel_route_contact_level"),
        "contact_date",
        F.col("cancel_reason").alias("cancellation_reason"),
    )
    recurring = pledges.filter((F.col("user_type2") != ONE_OFF) | F.col("user_type2").isNull())
    return recurring.select(
        F.col("pledge_uid").alias("commitment_id"),
        F.col("donor_no").alias("supporter_id"),
        F.col("submit_date").alias("commitment_date"),
        "start_month", "start_date", "end_month", "end_date", "end_check", "all_end_date", "payment_method", "org",
        "frequency",
        frequency.alias("commitment_frequency"),
        "donation_section",
        F.col("user_type1").alias("developer_old"),
        F.col("user_type2").alias("oneoff_check"),
        "entered",
        F.col("campaign_raw").alias("campaign_id"),
        channel_key(F.col("campaign_raw")).alias("channel_t"),
        F.col("pledge_active").alias("commitment_status"),
        "status", "pledge_status",
        classify(vocab.pledge_status).alias("pledge_status_eng"),
        F.col("rg_amount").alias("gift_amount"),
        "cancel_cal_date",
    ).join(donors, F.col("supporter_id") == F.col("_donor"), "left").drop("_donor")


def gift_extremes(transactions: DataFrame) -> DataFrame:
    """First and last gift amount and last gift date per pledge, in one aggregate.

    Ranked by (date, id); a missing date comes first. Gifts without a pledge can match none.
    """
    return extremes_of(gift_state(transactions))


def gift_state(transactions: DataFrame, *by: str) -> DataFrame:
    """First and last gift of each pledge (date, id and amount), and of each value of ``by``.

    ``merged`` adds up the states of several sets of gifts.
    """
    gift = F.struct("send_date", "tran_uid", "tran_amount")
    given = transactions.filter(F.col("pledge_uid").isNotNull())
    return given.groupBy("pledge_uid", *by).agg(F.min(gift).alias("first_gift"), F.max(gift).alias("last_gift"))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """One state per pledge from several; in any order and grouping the result is the state of all their gifts."""
    return states.groupBy("pledge_uid", *by).agg(F.min("first_gift").alias("first_gift"), F.max("last_gift").alias("last_gift"))


def extremes_of(state: DataFrame) -> DataFrame:
    return state.select(
        "pledge_uid",
        F.col("first_gift.tran_amount").alias("original_commitment_amount"),
        F.col("last_gift.tran_amount").alias("commitment_amount"),
        F.col("last_gift.send_date").alias("last_gift_date"),
    )


def _commitment_end(as_of: date) -> Column:
    """The recorded end; else the last gift plus grace, once the gift is older than the grace."""
    last = F.col("last_gift_date")

    def lapsed(every: int, grace: int) -> Column:
        return (F.col("frequency") == every) & (last < F.add_months(F.lit(as_of), -grace))

    return (
        F.when(F.col("end_date").isNotNull(), F.col("end_date"))
        .when(lapsed(1, 3), F.add_months(last, 3))
        .when(lapsed(12, 13), F.add_months(last, 13))
    )


def commitment_view(
    pledges: DataFrame, transactions: DataFrame, contacts: DataFrame, campaigns: DataFrame,
    as_of: date, loaded_at: datetime, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """One row per recurring pledge with donor, campaign, first and last gift and derived end date.

    ``as_of`` stands for today and ``loaded_at`` stamps the load, so a run can be repeated exactly.
    """
    return commitment_view_of(pledges, gift_extremes(transactions), contacts, campaigns, as_of, loaded_at, vocab=vocab)


def commitment_view_of(
    pledges: DataFrame, extremes: DataFrame, contacts: DataFrame, campaigns: DataFrame, as_of: date, loaded_at: datetime, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """The commitment view from each pledge's first and last gift, wherever they stem from."""
    gifts = extremes.withColumnRenamed("pledge_uid", "_pledge")
    core = with_lookup(commitment_core(pledges, contacts, vocab=vocab), campaigns, "campaign_id", "campaign_raw", ["campaign"])
    joined = core.join(gifts, F.col("commitment_id") == F.col("_pledge"), "left")
    return joined.select(
        "commitment_id", "supporter_id", "commitment_date", "start_month", "start_date", "end_month", "end_check",
        "all_end_date", "payment_method", "org", "name", "cancel_date_contact_level", "all_end_date_contact_level",
        "payment_method_contact_level", "cancel_route_contact_level", "contact_date", "commitment_frequency",
        F.lit("KRW").alias("currency_code"),
        "donation_section", "developer_old", "oneoff_check", "entered", "campaign_id", "channel_t",
        F.col("campaign").alias("commitment_description"),
        "original_commitment_amount", "commitment_amount", "commitment_status", "status", "pledge_status",
        "pledge_status_eng", "gift_amount",
        F.lit(None).cast("timestamp").alias("commitment_last_changed_date"),
        _commitment_end(as_of).alias("commitment_end_date"),
        "cancellation_reason",
        F.col("commitment_date").cast("timestamp").alias("created_date"),
        F.lit(None).cast("timestamp").alias("modified_date"),
        "cancel_cal_date",
        F.lit(loaded_at).cast("timestamp").alias("dl_load_date"),
    )


def existing_channels(channels: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Channel lookup rows for existing donors, the class whose keys are unique.

    What depends on the channel alone is worked out here, on the few lookup rows: ``acquiring`` tells the
    channels that count for active and new donors.
    """
    channel = F.col("channel_excl_upgrade")
    return channels.filter(F.col("acq_gb") == "Existing").withColumn(
        "acquiring",
        ~channel.isin(*vocab.non_acquiring_channels) & ~one_of_like(channel, vocab.non_acquiring_channel_patterns),
    )


PLEDGE_BASE_COLUMNS = (
    "org", "supporter_id", "commitment_id", "name", "pledge_status", "pledge_status_eng", "commitment_status",
    "end_check", "payment_method", "commitment_date", "pledge_nm", "all_end_date", "start_month", "end_month",
    "commitment_frequency", "donation_section", "developer_old", "oneoff_check", "gift_amount", "campaign_id",
    "channel_t", "entered", "cancel_cal_date", "cancel_status", "channel", "acq_gb", "new_site_code_acq",
    "channel_gb",
)


def classified_pledges(
    commitments: DataFrame, channels: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Commitments with their channel classes and Y/N cancel status, test and system names left out.

    Also carries ``acquiring`` and the donor's own end date, which the flags need.
    """
    lookup = existing_channels(channels, vocab=vocab).select(
        "channel_t", F.col("channel_excl_upgrade").alias("_channel"), "acq_gb", "new_site_code_acq",
        F.col("channel").alias("channel_gb"), "acquiring",
    )
    real = commitments.filter(~matches_any(F.col("name"), vocab.commitment_name_words))
    columns = ["_channel", "acq_gb", "new_site_code_acq", "channel_gb", "acquiring"]
    return (
        with_lookup(real, lookup, "channel_t", "channel_t", columns)
        .withColumnRenamed("_channel", "channel")
        .withColumn("cancel_status", F.when(F.col("status") == "3", "Y").otherwise("N"))
    )


def pledge_base(
    commitments: DataFrame, channels: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, *, stage: Stage
) -> DataFrame:
    """The classified pledges with each donor's pledge number, in the base table's columns."""
    numbered = ordinal(
        classified_pledges(commitments, channels, vocab),
        "supporter_id", ["commitment_date", "start_month"], "commitment_id", "pledge_nm", stage,
    )
    return numbered.select(*PLEDGE_BASE_COLUMNS)
