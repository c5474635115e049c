"""What the physical plans must and must not hold, over stand-in tables stored as parquet."""

import io
from contextlib import redirect_stdout

import pytest

from retenta.operators import staged
from retenta.plans import commitments, lists, oo_profile, retention, rg_profile
from retenta.sources import Sources
from verification import periods as p
from verification import registry
from verification.standin import StandIns

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def src(spark, tmp_path_factory):
    root, tables = tmp_path_factory.mktemp("tables"), StandIns(spark, SF)
    names = ("pledges", "contacts", "channel_gb", "classified_gifts", "transactions", "ltv_gifts", "income")
    for name in names:
        tables[name].write.parquet(str(root / name))
    return Sources(spark, {name: str(root / name) for name in names})


def plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def scan_of(text: str, table: str) -> str:
    """The details of the scans of one table."""
    parts = [part for part in text.split("\n\n") if "Scan parquet" in part and f"/{table}]" in part]
    assert parts, f"no scan of {table}"
    return "\n".join(parts)


@pytest.mark.parametrize("name", sorted(registry.JOBS))
def test_no_python_no_cross_join_no_forced_broadcast(spark, name):
    text = plan(registry.registered()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text
    assert "strategy=broadcast" not in text


def test_first_gift_is_cut_before_the_shuffle(src):
    text = plan(lists.new_donor_month(src["classified_gifts"], src["transactions"], p.MONTH))
    assert text.count("WindowGroupLimit") >= 2 * 2  # partial and final, in tree and details
    assert "Partial" in text and "Final" in text
    scan = scan_of(text, "classified_gifts")
    assert "GreaterThanOrEqual(transaction_date,1998-01-01)" in scan and "LessThan(transaction_date,1998-07-01)" in scan
    assert "EqualTo(acq_gb_simple,Acquisition)" in scan
    assert "payment_type" not in scan_of(text, "transactions")


@pytest.mark.parametrize("job", [lists.reactivation_list, lists.conversion_list])
def test_a_staged_list_spares_the_gift_table_its_shuffle(spark, src, tmp_path, job):
    gifts, transactions = src["classified_gifts"], src["transactions"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30KB")  # the gifts are above it, the list is below
    try:
        direct = job(gifts, transactions, p.YEAR)
        through = job(gifts, transactions, p.YEAR, stage=lambda df: staged(df, str(tmp_path), "list"))
        assert "hashpartitioning(_tran" in plan(direct)
        assert "hashpartitioning(_tran" not in plan(through)
        assert sorted(map(str, through.collect())) == sorted(map(str, direct.collect())) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_reads_no_gifts_and_few_columns(src):
    text = plan(retention.donor_retention_summary(src["pledges"], src["contacts"], src["channel_gb"], p.MONTH))
    assert "/transactions]" not in text
    scan = scan_of(text, "contacts")
    assert "home_zip" not in scan and "birth_date" not in scan
    assert "GreaterThanOrEqual(cancel_date,1998-06-01)" in scan and "LessThan(cancel_date,1998-07-01)" in scan


def test_lapsed_pledges_are_cut_before_they_are_joined(src):
    cancelled = retention.cancelled_contacts(src["contacts"], p.MONTH)
    text = plan(retention.lapsed_donors(src["pledges"], cancelled, src["channel_gb"]))
    assert "WindowGroupLimit" in text and "Partial" in text
    tree = text[:text.index("\n\n(1)")]
    assert "LeftSemi" in text and max(tree.rfind("WindowGroupLimit"), 0) < tree.rfind("LeftSemi")  # the cut stands below the ranking


def test_gift_extremes_meet_their_pledge_once(src):
    text = plan(commitments.gift_extremes(src["transactions"]))
    assert text.count("Arguments: hashpartitioning") == text.count("hashpartitioning(pledge_uid") == 1
    assert "ReadSchema: struct<tran_uid:string,pledge_uid:bigint,send_date:date,tran_amount:decimal(18,2)>" in text


def test_supporter_facts_are_one_scan_in_a_hash_map(src):
    facts = plan(oo_profile.supporter_facts(src["ltv_gifts"], p.YEAR))
    assert facts.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "SortAggregate" not in facts and "ObjectHashAggregate" not in facts
    assert "LessThan(transaction_date,19990101)" in facts


def test_a_narrow_job_reads_and_adds_only_what_it_shows(src):
    text = plan(oo_profile.gift_order_type(src["ltv_gifts"], p.YEAR))
    assert "transaction_amount" not in text and "source_id" not in text
    assert "GreaterThanOrEqual(transaction_date,19980101)" in text


def test_active_base_adds_up_before_the_shuffle(src):
    text = plan(rg_profile.rg_active_base(src["pledges"], p.YEAR))
    assert "Window" not in text and "partial_count" in text
    assert text.count("Arguments: hashpartitioning") == text.count("hashpartitioning(donor_no") == 1


def test_lookup_is_broadcast_only_by_its_size(spark, src):
    job = lambda: retention.donor_retention_summary(src["pledges"], src["contacts"], src["channel_gb"], p.MONTH)
    assert "BroadcastHashJoin" in plan(job())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(job())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_conversions_rank_the_single_gifts_of_converted_donors(src):
    text = plan(lists.conversion_list(src["classified_gifts"], src["transactions"], p.QUARTER))
    assert "LeftSemi" in text


def test_income_is_read_once(spark, src):
    tables = StandIns(spark, SF)
    info = rg_profile.rg_donor_info(rg_profile.rg_active_base(src["pledges"], p.YEAR), src["contacts"], src["channel_gb"], p.YEAR)
    text = plan(rg_profile.rg_addons(info, src["income"], tables["zip_code_region"]))
    assert text.count("/income]") == 1
