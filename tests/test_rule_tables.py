"""Rules as rows: read for one run, and analysed."""

import itertools
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from retenta import __main__ as cli
from retenta import rule_tables as rt
from retenta.functions.rules import Band, Rule, Test, classify, is_null, isin, like, same, unlike
from retenta.sources import REPORTS, read_report
from retenta.vocab import DEFAULT_VOCABULARY, Vocabulary

from test_workflows import places  # noqa: F401


def test_a_vocabulary_goes_through_a_table(spark, tmp_path):
    own = Vocabulary(own_name="Ours")
    rt.rule_table(spark, own).write.parquet(str(tmp_path / "rules"))
    back = rt.vocabulary_of(spark.read.schema(rt.SCHEMA).parquet(str(tmp_path / "rules")))
    assert (back.cancel_route, back.bank_ledger) == (own.cancel_route, own.bank_ledger)
    assert all(getattr(back, n) == getattr(own, n) for n in (*rt.RULE_LADDERS, *rt.BAND_LADDERS))
    assert rt.vocabulary_of(spark.createDataFrame([], rt.SCHEMA), own) == own


def row(ladder="enrol_type", place=1, label="x", keep=None, tests=(("enroll", "isin", ["a"]),), low=None, high=None):
    return (ladder, place, label, keep, list(tests) if tests is not None else None, low, high)


@pytest.mark.parametrize("rows", [
    [row(ladder="no_such")], [row(place=2)], [row(), row()], [row(tests=None)], [row(tests=())], [row(label=None)], [row(keep="enroll")],
    [row(tests=[("enroll", "glob", ["a"])])], [row(tests=[("enroll", "isin", [])])], [row(tests=[("enroll", "is_null", ["a"])])],
    [row(ladder="oo_age_bands", tests=None)], [row(ladder="oo_age_bands", tests=None, label=None, low=1)], [row(ladder=None)],
])
def test_unusable_tables_stop_a_run(spark, rows):
    with pytest.raises(rt.BadRules):
        rt.vocabulary_of(spark.createDataFrame(rows, rt.SCHEMA))


def test_runs_use_the_rules_of_their_table(spark, places, tmp_path):  # noqa: F811
    """The month, the quarter and both yearly profiles, each with a changed ladder."""
    other = (Rule.of("changed", unlike("channel", "no such%")),)
    vocab = replace(
        DEFAULT_VOCABULARY, f2f_type=other, rg_channel_g2=(Rule.of("changed", is_null("channel_t")),), region_classes=(Rule.of("changed", like("region", "%")),),
        oo_age_bands=(Band("any age", 0, None),), rg_gift_bands=(Band("any gift", None, 10 ** 9),), oo_channel_short=(Rule.of("short", like("channel_gb2", "%")),))
    rt.rule_table(spark, vocab).write.parquet(str(tmp_path / "rules"))
    out, rules = str(tmp_path / "out"), ["--rules", str(tmp_path / "rules")]
    for cadence, period in (("month", "1998-06"), ("month", "1998-05"), ("month", "1998-04"), ("quarter", "1998Q2"), ("year", "1998")):
        cli.main([cadence, period, str(places), out, *rules])
    values = lambda report, c: {r[0] for r in read_report(spark, REPORTS[report], f"{out}/{report}").select(c).distinct().collect()}
    assert values("retention_report", "f2f_type_street_b2b") <= {"changed", "Other"} and "changed" in values("retention_report", "f2f_type_street_b2b")
    assert values("rg_profile", "gift_band") <= {"any gift", "No data"} and "any gift" in values("rg_profile", "gift_band")
    assert values("rg_profile", "region_3") == {"changed"}
    assert "any age" in values("oo_profile", "age_band") and "short" in values("oo_profile", "channel_s")


# --- analysis ---


def matches(pattern, text):
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def test_patterns_within_others_are_never_wrongly_told():
    texts = ["".join(t) for n in range(5) for t in itertools.product("abc", repeat=n)]
    patterns = ["".join(p) for n in range(1, 4) for p in itertools.product("ab%_", repeat=n)]
    told = 0
    for a, b in itertools.product(patterns, repeat=2):
        if rt.pattern_within(a, b):
            told += 1
            assert all(matches(b, t) for t in texts if matches(a, t)), (a, b)
    assert told > 600
    assert rt.pattern_within("F2F SW%", "F2F%") and rt.pattern_within("%a%", "%%a%") and not rt.pattern_within("F2F%", "F2F SW%")


def test_tests_that_imply_or_exclude_each_other(spark):
    tests = [Test("f", op, values) for op, values in (
        ("isin", ("ab",)), ("isin", ("ab", "b")), ("isin", ("c",)), ("like", ("a%",)), ("like", ("%",)), ("like", ("%b", "a_")), ("unlike", ("a%",)),
        ("unlike", ("a%", "b")), ("unlike", ("%",)), ("is_null", ()))]
    texts = [None, *("".join(t) for n in range(4) for t in itertools.product("abc", repeat=n))]
    frame = spark.createDataFrame([(t,) for t in texts], "f string")
    holds = [classify([Rule.of("y", t)], otherwise="n").alias(f"t{i}") for i, t in enumerate(tests)]
    held = [[r[i] == "y" for r in frame.select(*holds).collect()] for i in range(len(tests))]
    for (i, a), (j, b) in itertools.product(enumerate(tests), repeat=2):
        both = list(zip(held[i], held[j], strict=True))
        assert not rt.implies(a, b) or all(y for x, y in both if x), (a, b)
        assert not rt.excludes(a, b) or not any(x and y for x, y in both), (a, b)
    assert rt.implies(tests[0], tests[3]) and rt.implies(tests[7], tests[6]) and rt.excludes(tests[3], tests[6]) and rt.excludes(tests[2], tests[5])


def test_dead_rules_and_gaps_are_named():
    shadowed = [Rule.of("Email/Mail", isin("r", "이메일", "우편")), Rule.of("Mail", same("r", "우편")), Rule.of("F2F", like("c", "F2F%")),
                Rule.of("B2B", like("c", "F2F%B2B"), same("r", "x")), Rule.of("never", same("r", "a"), like("r", "b%")), Rule.of("fine", like("c", "%"))]
    assert [(f.label, f.because) for f in rt.dead_rules("x", shadowed)] == [
        ("Mail", "rule 1 (Email/Mail) takes all"), ("B2B", "rule 3 (F2F) takes all"), ("never", "contradicts itself on r")]
    assert [f.label for f in rt.dead_rules("x", [Rule.of("gone", is_null("r"))], [unlike("r", "z")])] == ["gone"]
    bands = [Band("a", None, 10), Band("b", 12, 20), Band("covered", 13, 15), Band("also", 5, 10), Band("c", 21, None)]
    assert [(f.kind, f.label or f.because) for f in rt.band_faults("x", bands, whole=True)] == [("dead", "covered"), ("dead", "also"), ("gap", "10 to 12")]
    assert [f.because for f in rt.band_faults("x", bands) if f.kind == "gap"] == ["10 to 12", "20 to 21"]
    found = rt.rule_findings()
    assert {(f.ladder, f.label) for f in found if f.kind == "dead"} == {("cancel_route", "No data"), ("cancel_route", "Donorcare line")}
    assert {(f.ladder, f.because) for f in found if f.kind == "gap"} == {
        ("cross_sell_bands", g) for g in ("10000 to 10001", "50000 to 50001", "100000 to 100001", "500000 to 500001")}


def test_usage_counts_what_each_rule_takes(spark):
    rows = spark.createDataFrame([("개인", 20), ("개인", None), ("other", 18), (None, 90)], "enroll string, age int")
    got = {r.place: (r.label, r.rows) for r in rt.rule_usage(rows, "enrol_type").collect()}
    assert got == {0: (None, 2), 1: ("Individual", 2), 2: ("Group", 0), 3: ("Foreigner", 0)}
    bands = {r.label: r.rows for r in rt.rule_usage(rows, "oo_age_bands", value="age").where(F.col("rows") > 0).collect()}
    assert bands == {None: 1, "under 18": 1, "19~25": 1, "over 61": 1}
    assert rt.rule_usage(rows.limit(0), "enrol_type").agg(F.sum("rows")).first()[0] == 0
