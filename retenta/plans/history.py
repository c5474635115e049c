"""The retention report of a range of months from one reading of the pledges.

A pledge counts as active from the month it was signed to the month before its first end. So it is two events: one more
active pledge, and one less. Events are added up by month and channel, and running sums over the months of a channel
give the counts of each month. What follows the first aggregate has a row for each channel and month, however many
pledges there are and however many months are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import month_start
from ..period import Period
from ..vocab import DEFAULT_VOCABULARY, Vocabulary
from .commitments import classified_pledges, commitment_core
from .retention import cancelled_contacts, dash_lapsed, ends, labelled_counts, lapsed_donors, lapsed_flags, recurring, retention_summary, signing_kinds

CHANNEL = ("new_site_code_acq", "channel_gb", "channel")
COUNTS = {"new_donors": "new_donor", "active_donors": "active_donor", "reactivation_donors": "reactivation", "conversion_donors": "conversion"}


def month_number(day: Column) -> Column:
    """Months since year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def first_of(number: Column) -> Column:
    return F.make_date((number / 12).cast("int"), number % 12 + 1, F.lit(1))


def pledge_events(base: DataFrame, span: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """What each classified pledge changes, and when: CHANNEL, month (a number) and what to add to each flag's count.

    ``active_donor`` is a change that lasts; the others count in their month only. Every pledge has an event in the first
    month, if only of zeros, so that a channel without any counted pledge is known.
    """
    months = span.months()
    first, last = (month_number(F.lit(m.start)) for m in (months[0], months[-1]))
    signed = month_number(F.col("commitment_date"))
    until = F.coalesce(month_number(F.least(*ends())), last + 1)
    ok = F.coalesce(recurring(vocab), F.lit(False)) & F.col("supporter_id").isNotNull()
    start = F.greatest(F.coalesce(signed, first), first)
    active = ok & F.coalesce(F.col("acquiring"), F.lit(False)) & (start < until)

    def event(month: Column, **changes: Column) -> Column:
        none = F.lit(0)
        return F.struct(month.cast("int").alias("month"), *[changes.get(c, none).cast("int").alias(c) for c in COUNTS.values()])

    signing = ok & (signed >= first) & (signed <= last) & (signed < until)
    events = F.array(
        event(first, active_donor=active & (start == first)),
        F.when(active & (start > first) & (start <= last), event(start, active_donor=F.lit(1))),
        F.when(active & (until <= last), event(until, active_donor=F.lit(-1))),
        F.when(signing, event(signed, **{name: F.coalesce(kind, F.lit(False)) for name, kind in signing_kinds().items()})),
    )
    return base.select(*CHANNEL, F.inline(F.filter(events, lambda e: e.isNotNull())))


def donor_history(base: DataFrame, span: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """The donor half of the report for every month of ``span``, as ``dash_donor`` gives it for one."""
    last = month_number(F.lit(span.months()[-1].start))
    sums = pledge_events(base, span, vocab).groupBy(*CHANNEL, "month").agg(*[F.sum(c).alias(c) for c in COUNTS.values()])
    by_month = Window.partitionBy(*CHANNEL).orderBy("month")
    sums = sums.withColumns({
        "active_donor": F.sum("active_donor").over(by_month),
        "_until": F.coalesce(F.lead("month").over(by_month) - 1, last.cast("int")),
    })
    each = sums.select("*", F.explode(F.sequence("month", "_until")).alias("_at"))
    own = F.col("_at") == F.col("month")
    counts = [(F.col(c) if c == "active_donor" else F.when(own, F.col(c)).otherwise(0)).alias(name) for name, c in COUNTS.items()]
    return labelled_counts(each.select(first_of(F.col("_at")).alias("review_month"), *CHANNEL, *counts), COUNTS, vocab)


def lapsed_history(
    pledges: DataFrame, contacts: DataFrame, channels: DataFrame, span: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """The lapsed half: a donor cancels once, so each counts in the month of the cancellation."""
    lapsed = lapsed_donors(pledges, cancelled_contacts(contacts, span, vocab), channels, vocab)
    return dash_lapsed(lapsed_flags(lapsed, span, vocab=vocab).withColumn("review_month", month_start(F.col("cancel_date"))), vocab)


def retention_history(
    pledges: DataFrame, contacts: DataFrame, channels: DataFrame, span: Period,
    vocab: Vocabulary = DEFAULT_VOCABULARY, coalesce_period: bool = True,
) -> DataFrame:
    """The rows of ``donor_retention_summary`` of every month of ``span``, by month and site code.

    Pledges are read twice (all of them, and those of donors who cancelled), as for one month. Rows with lapsed counts only
    get their month, unless ``coalesce_period`` is unset.
    """
    base = classified_pledges(commitment_core(pledges, contacts, vocab=vocab), channels, vocab)
    donors, lapsed = donor_history(base, span, vocab), lapsed_history(pledges, contacts, channels, span, vocab)
    return retention_summary(donors, lapsed, coalesce_period).orderBy("month_first", "channel_sitecode")
