"""The monthly retention report: donor flags, lapsed flags and their summary by channel."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import band, channel_key, classify, first_of_month_text, matches_any, month_diff, month_start
from ..functions import one_of_like
from ..operators import Stage, first_per_key, ordinal, with_lookup
from ..period import Period
from ..vocab import CONVERSION_SITE, DEFAULT_VOCABULARY, OFFICE_ROUTE, OVERDUE_REASON, REACTIVATION_SITE, Vocabulary
from .commitments import classified_pledges, commitment_core, existing_channels

DIMENSIONS = ("review_month", "channel_sitecode", "channel_gb", "recruit_channel", "f2f_type_street_b2b",
              "f2f_channel_gb")


def _y_if(condition: Column) -> Column:
    return F.when(condition, "y").otherwise("n")


def _after(day: Column, month: Period) -> Column:
    """No date, or one in a later month."""
    return day.isNull() | (day >= F.lit(month.end_exclusive))


def recurring(vocab: Vocabulary) -> Column:
    """What all four flags ask of a pledge in any month."""
    return (
        F.col("campaign_id").isNotNull()
        & F.col("payment_method").isin(*vocab.recurring_methods)
        & F.col("start_month").isNotNull()
        & F.col("oneoff_check").isNull()
    )


def ends() -> list[Column]:
    """The dates of which each, where there is one, must lie in a later month than the review month."""
    return [F.col("all_end_date_contact_level"), F.to_date("cancel_cal_date", "yyyy-MM-dd"), first_of_month_text(F.col("end_month"))]


def signing_kinds() -> dict[str, Column]:
    """What a pledge counts as in the month it is signed, apart from what ``recurring`` and ``ends`` ask."""
    site, existing = F.col("new_site_code_acq"), F.col("acq_gb") == "Existing"
    return {
        "new_donor": ~site.isin(REACTIVATION_SITE, CONVERSION_SITE) & F.col("acquiring"),
        "reactivation": existing & (site == REACTIVATION_SITE),
        "conversion": existing & (site == CONVERSION_SITE),
    }


def _eligible(month: Period, vocab: Vocabulary) -> Column:
    """What all four flags ask of a pledge and its donor."""
    return reduce(lambda a, b: a & b, [recurring(vocab), *[_after(day, month) for day in ends()]])


def donor_flags(base: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Active, new, reactivation and conversion flags of classified pledges in the review month.

    Needs ``all_end_date_contact_level`` and ``acquiring``, which classified pledges carry, so neither
    contacts nor channels are joined again.
    """
    signed = F.col("commitment_date")
    in_month = month.holds(signed)
    eligible = F.col("_eligible")
    return (
        base.withColumn("_eligible", _eligible(month, vocab))
        .withColumns({
            "commitment_month": month_start(signed),
            "active_donor": _y_if(eligible & (signed.isNull() | (signed < F.lit(month.end_exclusive))) & F.col("acquiring")),
            **{name: _y_if(eligible & in_month & kind) for name, kind in signing_kinds().items()},
            "review_month": F.lit(month.start),
        })
        .drop("_eligible", "acquiring")
    )


def cancelled_contacts(contacts: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Donors who cancelled in the month themselves, paid by a recurring method and are not test entries.

    Of a period of several months: those who count in any one of them. Everything must have ended in the month of the
    cancellation.
    """
    return contacts.filter(
        month.holds(F.col("cancel_date"))
        & (F.col("all_end_date") < F.add_months(month_start(F.col("cancel_date")), 1))
        & (F.col("cancel_route") != OFFICE_ROUTE)
        & F.col("payment_method").isin(*vocab.recurring_methods)
        & ~matches_any(F.col("name"), vocab.cancelled_excluded_names)
    )


CANCELLED_COLUMNS = (
    "donor_no", "org", "gift_amount", "contact_date", "cancel_date", "lifetime", "cancel_year", "cancel_month",
    "channel_t", "tot_amt", "tot_tran", "developer_old", "location", "cancel_route", "cancel_route_eng", "ltm_band",
    "lty_band", "submit_date", "pledge_nm",
)


def _counted_pledges(pledges: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    campaign = F.col("campaign_raw")
    return pledges.filter(campaign.isNotNull() & ~one_of_like(campaign, vocab.lapsed_excluded_campaigns)).select(
        "pledge_uid", "donor_no", "org", F.col("rg_amount").alias("gift_amount"),
        channel_key(campaign).alias("channel_t"), F.col("user_type1").alias("developer_old"),
        F.col("user_input_1").alias("location"), "submit_date", "start_month",
    )


def _own_wish(cancelled: DataFrame) -> DataFrame:
    return cancelled.filter(~F.col("cancel_reason").like(OVERDUE_REASON)).select(
        "donor_no", "contact_date", "cancel_date", "tot_amt", "tot_tran", "cancel_route", "cancel_reason"
    )


def _with_cancellation(counted: DataFrame, cancelled: DataFrame, vocab: Vocabulary) -> DataFrame:
    lifetime = F.col("lifetime")
    return (
        counted.join(_own_wish(cancelled), "donor_no")
        .withColumn("lifetime", month_diff(F.col("cancel_date"), F.col("contact_date")))
        .withColumns({
            "cancel_year": F.date_format("cancel_date", "yyyy"),
            "cancel_month": F.date_format("cancel_date", "yyMM"),
            "cancel_route_eng": classify(vocab.cancel_route, otherwise="ERROR"),
            "ltm_band": band(lifetime, vocab.tenure_quarter_bands, ""),
            "lty_band": band(lifetime, vocab.tenure_year_bands, ""),
        })
    )


def cancelled_pledges(
    pledges: DataFrame, cancelled: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, *, stage: Stage
) -> DataFrame:
    """All counted pledges of the cancelled donors, numbered per donor, with tenure and route labels."""
    rows = _with_cancellation(_counted_pledges(pledges, vocab=vocab), cancelled, vocab)
    numbered = ordinal(stage(rows), "donor_no", ["submit_date", "start_month"], "pledge_uid", "pledge_nm", stage)
    return numbered.select(*CANCELLED_COLUMNS)


def lapsed_donors(
    pledges: DataFrame, cancelled: DataFrame, channels: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """Cancelled donors by the channel of their first pledge, excluded site codes left out.

    Only the cancelled donors' pledges are ranked. A donor cancels as a whole, so the first pledge is found before
    the join: one row per donor meets it.
    """
    theirs = _counted_pledges(pledges, vocab=vocab).join(_own_wish(cancelled).select("donor_no"), "donor_no", "left_semi")
    first = first_per_key(theirs, ["donor_no"], ["submit_date", "start_month", "pledge_uid"])
    rows = _with_cancellation(first, cancelled, vocab)
    numbered = rows.withColumn("pledge_nm", F.lit(1).cast("bigint")).select(*CANCELLED_COLUMNS)
    lookup = existing_channels(channels, vocab=vocab).select(
        "channel_t", "new_site_code_acq", F.col("channel_excl_upgrade").alias("_channel"),
        F.col("channel").alias("channel_gb"),
    )
    return (
        with_lookup(numbered, lookup, "channel_t", "channel_t", ["new_site_code_acq", "_channel", "channel_gb"])
        .withColumnRenamed("_channel", "channel")
        .filter(~F.col("new_site_code_acq").isin(*vocab.lapsed_excluded_sites))
    )


def lapsed_flags(lapsed: DataFrame, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Lapsed in the month: at all, within three months of joining, within twelve."""
    in_month = month.holds(F.col("cancel_date"))
    return lapsed.withColumns({
        "lapsed": _y_if(in_month),
        "lapsed_3m": _y_if(in_month & (F.col("ltm_band") == vocab.tenure_quarter_bands[0].label)),
        "lapsed_12m": _y_if(in_month & (F.col("lty_band") == vocab.tenure_year_bands[0].label)),
        "review_month": F.lit(month.start),
    })


def _count_by_dimension(flags: DataFrame, who: str, counts: dict[str, str], vocab: Vocabulary) -> DataFrame:
    """Counted by channel first and labelled after, so the rule tables run per channel, not per pledge."""
    raw = flags.groupBy("review_month", "new_site_code_acq", "channel_gb", "channel").agg(
        *[F.count(F.when(F.col(flag) == "y", F.col(who))).alias(name) for name, flag in counts.items()]
    )
    return labelled_counts(raw, counts, vocab)


def labelled_counts(raw: DataFrame, counts: Iterable[str], vocab: Vocabulary) -> DataFrame:
    """Counts by review month and channel, added up by the labels of the report."""
    return (
        raw.select(
            "review_month",
            F.col("new_site_code_acq").alias("channel_sitecode"),
            "channel_gb",
            classify(vocab.recruit_channel, otherwise=F.col("channel")).alias("recruit_channel"),
            classify(vocab.f2f_type, otherwise="Other").alias("f2f_type_street_b2b"),
            classify(vocab.f2f_detail, otherwise="Not F2F").alias("f2f_channel_gb"),
            *counts,
        )
        .groupBy(*DIMENSIONS)
        .agg(*[F.sum(name).alias(name) for name in counts])
    )


def dash_donor(flags: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Pledges per flag by channel dimensions."""
    counts = {"new_donors": "new_donor", "active_donors": "active_donor", "reactivation_donors": "reactivation",
              "conversion_donors": "conversion"}
    return _count_by_dimension(flags, "supporter_id", counts, vocab)


def dash_lapsed(flags: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Lapsed donors per flag by the same dimensions."""
    counts = {"lapsed_donors": "lapsed", "lapsed_donors_3m": "lapsed_3m", "lapsed_donors_12m": "lapsed_12m"}
    return _count_by_dimension(flags, "donor_no", counts, vocab)


def retention_summary(donors: DataFrame, lapsed: DataFrame, coalesce_period: bool = False) -> DataFrame:
    """Both dashes side by side, rows with any count, sorted by site code.

    The keys meet by plain equality: a NULL key matches nothing and both sides stay. A row with lapsed
    counts only has no period unless ``coalesce_period`` is set.
    """
    d, la = donors.alias("d"), lapsed.alias("l")
    joined = d.join(la, reduce(lambda a, b: a & b, [F.col(f"d.{c}") == F.col(f"l.{c}") for c in DIMENSIONS]), "full")
    counts = {
        "new_donor": "d.new_donors", "active_donor": "d.active_donors", "lapsed_donor": "l.lapsed_donors",
        "lapsed_3m": "l.lapsed_donors_3m", "lapsed_12m": "l.lapsed_donors_12m",
        "reactivation_donor": "d.reactivation_donors", "conversion_donor": "d.conversion_donors",
    }
    month = F.coalesce("d.review_month", "l.review_month") if coalesce_period else F.col("d.review_month")
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts.values()])
    return (
        joined.filter(total > 0)
        .select(
            F.date_format(month, "yyyy-MM").alias("period"),
            month.alias("month_first"),
            *[F.coalesce(f"d.{c}", f"l.{c}").alias(c) for c in DIMENSIONS[1:]],
            *[F.col(c).alias(name) for name, c in counts.items()],
        )
        .orderBy("channel_sitecode")
    )


def donor_retention_summary(
    pledges: DataFrame, contacts: DataFrame, channels: DataFrame, month: Period,
    vocab: Vocabulary = DEFAULT_VOCABULARY, coalesce_period: bool = False,
) -> DataFrame:
    """The monthly retention report from the source tables.

    Gift amounts, campaign text and pledge numbers are not in it, so those joins are not planned at all.
    """
    base = classified_pledges(commitment_core(pledges, contacts, vocab=vocab), channels, vocab)
    lapsed = lapsed_donors(pledges, cancelled_contacts(contacts, month, vocab), channels, vocab)
    return retention_summary(
        dash_donor(donor_flags(base, month, vocab), vocab),
        dash_lapsed(lapsed_flags(lapsed, month, vocab=vocab), vocab),
        coalesce_period,
    )


def flag_crosstab(donors: DataFrame, lapsed: DataFrame) -> DataFrame:
    """Rows and distinct donors per combination of the seven flags."""
    flags = ["active_donor", "new_donor", "reactivation", "conversion", "lapsed", "lapsed_3m", "lapsed_12m"]
    right = lapsed.select(F.col("donor_no").alias("_donor"), "lapsed", "lapsed_3m", "lapsed_12m")
    return (
        donors.join(right, F.col("supporter_id") == F.col("_donor"), "left")
        .groupBy(*flags)
        .agg(F.count("supporter_id").alias("nmbr"), F.countDistinct("supporter_id").alias("dist_nmbr"))
    )
