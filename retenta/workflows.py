"""The monthly, quarterly and yearly runs: read the sources, build the reports, replace their period.

Each report is one Spark write. A run that fails or is repeated leaves one copy of its period.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame

from .operators import RunFolder, require_unique
from .period import Period
from .plans import commitments, distinct_rollup, history, lists, monthly, oo_profile, retention, rg_profile
from .sources import LOOKUP_KEYS, REPORTS, Sources, append_period, create_or_replace, read_report, rewrite_without
from .sources.gift_states import GiftStates
from .vocab import DEFAULT_VOCABULARY, Vocabulary

# Settings a cluster session should carry. Adaptive execution splits skewed joins and turns a join into a
# broadcast only after measuring the side; the thresholds are Spark's own defaults, named here because the
# jobs rely on them. Shuffle partitions: start high, adaptive execution merges small ones.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.session.timeZone": "UTC",
}


def check_lookups(sources: Sources, *names: str) -> None:
    """Raise DuplicateKeys if a lookup names one key twice, which would multiply report rows."""
    for name in names:
        require_unique(sources[name], LOOKUP_KEYS[name], name)


def _store(df: DataFrame, report: str, out: str, period: str) -> None:
    append_period(df, REPORTS[report], f"{out}/{report}", period)


def _keep(df: DataFrame, name: str, out: str, period: str) -> None:
    """Store a list or count that has no fixed report schema, in its own columns."""
    append_period(df, df.schema, f"{out}/{name}", period)


def _run_folder(sources: Sources, out: str) -> RunFolder:
    """Where a run stores its short lists: beside its output, in a folder no other run uses."""
    return RunFolder(sources.spark, f"{out}/_staging")


class MissingMonths(ValueError):
    """A quarter was asked for before all its months were run."""


def _stored_new_donors(sources: Sources, quarter: Period, out: str) -> DataFrame:
    stored = read_report(sources.spark, REPORTS["new_donor"], f"{out}/new_donor")
    first = quarter.start.month
    wanted = {Period.month(quarter.start.year, m).label for m in range(first, quarter.last_day.month + 1)}
    fs = sources.spark.sparkContext._jvm.org.apache.hadoop.fs
    places = {m: fs.Path(f"{out}/new_donor/report_period={m}") for m in wanted}
    system = fs.Path(out).getFileSystem(sources.spark.sparkContext._jsc.hadoopConfiguration())
    missing = sorted(m for m, place in places.items() if not system.exists(place))
    if missing:
        raise MissingMonths(f"no stored new-donor list for {', '.join(missing)}")
    return stored


def refresh_commitment_view(
    sources: Sources, out: str, as_of: date, loaded_at: datetime, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> None:
    """Replace the stored commitment view."""
    check_lookups(sources, "campaigns", "contacts", "transactions")
    view = commitments.commitment_view(
        sources["pledges"], sources["transactions"], sources["contacts"], sources["campaigns"], as_of, loaded_at, vocab
    )
    create_or_replace(view, f"{out}/commitment_view")


def refresh_commitment_view_by_months(
    sources: Sources, out: str, as_of: date, loaded_at: datetime, months: Sequence[Period] | None,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> None:
    """Replace the stored commitment view, reading of the gifts only ``months`` (None: all of them, to begin with)."""
    check_lookups(sources, "campaigns", "contacts")
    states, gifts = GiftStates(sources.spark, f"{out}/gift_states"), sources["transactions"]
    if months is None:
        states.build(gifts)
    else:
        states.refresh(gifts, months)
    extremes = commitments.extremes_of(states.state(gifts))
    view = commitments.commitment_view_of(sources["pledges"], extremes, sources["contacts"], sources["campaigns"], as_of, loaded_at, vocab)
    create_or_replace(view, f"{out}/commitment_view")


def run_month(sources: Sources, month: Period, out: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> None:
    """The retention report and the month's new-donor list."""
    check_lookups(sources, "channel_gb", "contacts", "transactions")
    summary = retention.donor_retention_summary(
        sources["pledges"], sources["contacts"], sources["channel_gb"], month, vocab
    )
    _store(summary, "retention_report", out, month.label)
    with _run_folder(sources, out) as stage:
        new = lists.new_donor_month(sources["classified_gifts"], sources["transactions"], month, vocab, stage=stage)
        _store(new, "new_donor", out, month.label)


def run_history(sources: Sources, span: Period, out: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> None:
    """The retention report of every month of ``span``, from one reading of the pledges; replaces each month's stored report."""
    check_lookups(sources, "channel_gb", "contacts")
    with _run_folder(sources, out) as stage:
        found = stage(history.retention_history(sources["pledges"], sources["contacts"], sources["channel_gb"], span, vocab))
        for month in span.months():
            _store(found.filter(month.holds(found["month_first"])), "retention_report", out, month.label)


def run_month_counts(sources: Sources, month: Period, out: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> None:
    """Store the month's counts and small lists, the data checks and the flag cross-tab, a table each."""
    check_lookups(sources, "channel_gb", "contacts")
    distinct_rollup.store_bitmaps(sources["transactions"], month, f"{out}/oneoff_donor_bitmaps")
    for name, frame in {**month_counts(sources, month, vocab), **data_checks(sources, month, vocab)}.items():
        _keep(frame, name, out, month.label)


def run_oneoff_rollup(sources: Sources, span: Period, out: str) -> None:
    """Distinct one-off donors of every month, quarter, half and year in ``span``, from the bitmaps that its months have stored."""
    bitmaps = distinct_rollup.stored_bitmaps(sources["transactions"], f"{out}/oneoff_donor_bitmaps", span)
    _keep(distinct_rollup.oneoff_rollup(bitmaps), "oneoff_rollup", out, span.label)


def data_checks(sources: Sources, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, DataFrame]:
    """Pledges to correct before the report, and the flags counted against each other."""
    pledges, contacts, channels = sources["pledges"], sources["contacts"], sources["channel_gb"]
    base = commitments.classified_pledges(commitments.commitment_core(pledges, contacts, vocab), channels, vocab)
    cancelled = retention.cancelled_contacts(contacts, month, vocab)
    lapsed = retention.lapsed_donors(pledges, cancelled, channels, vocab)
    return {
        "dq_missing_campaign": commitments.missing_campaign(pledges, month, vocab),
        "dq_inhouse_unmarked": commitments.inhouse_unmarked(pledges, month),
        "flag_crosstab": retention.flag_crosstab(
            retention.donor_flags(base, month, vocab), retention.lapsed_flags(lapsed, month, vocab)
        ),
    }


def month_counts(
    sources: Sources, month: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> dict[str, DataFrame]:
    """The month's counts and small lists, by name; nothing runs until one is shown or written."""
    transactions, contacts, crm = sources["transactions"], sources["contacts"], sources["crm_contacts"]
    ledger = sources["bank_ledger"]
    return {
        "oneoff_headcount": monthly.oneoff_headcount(transactions, month),
        "oneoff_by_section": monthly.oneoff_by_section(transactions, month),
        "email_subscribers": monthly.email_subscribers(contacts, month),
        "internal_cancel_by_route": monthly.internal_cancel_by_route(
            contacts, sources["pledges"], sources["channel_gb"], month, vocab
        ),
        "external_cancel_by_route": monthly.external_cancel_by_route(
            sources["change_history"], sources["cms_results"], crm, month, vocab
        ),
        "bank_income_class": monthly.bank_income_class(ledger, month, vocab),
        "anonymous_oneoff": monthly.anonymous_oneoff(ledger, transactions, month, vocab=vocab),
        "refund_list": monthly.refund_list(sources["case_log"], crm, month),
    }


def run_quarter(
    sources: Sources, quarter: Period, out: str, redraw: bool = False, through_chains: bool = False, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> None:
    """The quarter's active-donor summary, its donor lists with their read-outs, and the conversion cross-check.

    New donors come from the stored monthly lists, of which all three months must be there; ``redraw`` draws them
    afresh, because member numbers may have changed since. The cross-check marks conversions that stand in the
    new-donor list, and looks the others up under their former numbers (``through_chains``: over several merges).
    """
    check_lookups(sources, "contacts", "transactions")
    gifts, transactions = sources["classified_gifts"], sources["transactions"]
    last = quarter.last_day
    window, ytd = Period.trailing(last.year, last.month), Period.ytd(last.year, last.month)
    with _run_folder(sources, out) as stage:
        new = lists.new_donor_quarter(gifts, transactions, ytd, stage=stage, vocab=vocab) if redraw else _stored_new_donors(sources, quarter, out)
        active = lists.active_donor_summary(sources["gift_facts"], sources["contacts"], window, quarter.label)
        _store(active, "active_donor_summary", out, quarter.label)
        taken = lists.quarter_slice(new, "first_transaction_date", quarter, REPORTS["new_donor"].fieldNames())
        _store(taken, "quarter_new_donor", out, quarter.label)
        returned = lists.reactivation_list(gifts, transactions, quarter, stage, vocab)
        _store(returned, "reactivation_donor", out, quarter.label)
        converted = stage(lists.conversion_list(gifts, transactions, quarter, stage, vocab))
        _store(converted, "conversion_donor", out, quarter.label)
        for name, listed, date in (
            ("new_donor_readout", taken, "first_transaction_date"), ("reactivation_readout", returned, "reactivation_date"),
            ("conversion_readout", converted, "conversion_date"),
        ):
            _keep(lists.read_out(listed, date, quarter), name, out, quarter.label)
        checked = stage(lists.conversion_in_new_donor(converted, new, quarter))
        _keep(checked, "conversion_in_new_donor", out, quarter.label)
        former = lists.resolve_merged_donors(
            checked, sources["merge_history"], sources["merge_history_detail"], new, through_chains, stage
        )
        _keep(former, "former_member_numbers", out, quarter.label)


def run_year(sources: Sources, year: Period, out: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> None:
    """The yearly profiles of regular and one-off givers."""
    check_lookups(sources, "channel_gb", "ltv_channel_gb", "don_section", "zip_code_region", "contacts")
    _keep(rg_profile.income_control_totals(sources["income"]), "income_control_totals", out, year.label)
    base = rg_profile.rg_active_base(sources["pledges"], year, vocab)
    info = rg_profile.rg_donor_info(base, sources["contacts"], sources["channel_gb"], year, vocab)
    addons = rg_profile.rg_addons(info, sources["income"], sources["zip_code_region"], vocab)
    _store(rg_profile.rg_profile_rows(rg_profile.rg_profile(addons, year, vocab)), "rg_profile", out, year.label)
    profile = oo_profile.oo_profile(
        sources["ltv_gifts"], sources["contacts"], sources["ltv_channel_gb"], sources["don_section"],
        sources["zip_code_region"], year, vocab,
    )
    _store(oo_profile.oo_profile_rows(profile, year), "oo_profile", out, year.label)


def remove_rg_outliers(
    sources: Sources, year: Period, out: str, rules: Sequence[Mapping[str, Any]] | None = None
) -> None:
    """Take known bad rows out of the stored profile of a year; they are kept under ``audit`` for review."""
    path, schema = f"{out}/rg_profile", REPORTS["rg_profile"]
    stored = read_report(sources.spark, schema, path).filter(f"report_period = '{year.label}'")
    kept, removed = rg_profile.rg_profile_outliers(stored, year, rules)
    rewrite_without(kept, removed, schema, path, year.label, f"{out}/audit/rg_profile")
