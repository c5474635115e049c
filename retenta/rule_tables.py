"""Rules and bands as rows of a table: written, read for one run, and analysed.

A row is a rule of a ladder (``recruit_channel`` and so on: the fields of ``Vocabulary`` that hold rules or bands). Of a rule
it has the tests, of a band the edges. The rules of a run are few and become one CASE each, so they are read on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import fields, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import Band, Rule, Test, band, classify
from .vocab import DEFAULT_VOCABULARY, Vocabulary

SCHEMA = "ladder string, place int, label string, keep string, tests array<struct<field: string, op: string, values: array<string>>>, low bigint, high bigint"
MOST_ROWS = 10_000
OWN_LADDERS = {"cancel_route": "cancel_route_rules", "bank_ledger": "bank_ledger_rules"}
#: Fields of ``Vocabulary`` that hold bands, and those that hold rules.
BAND_LADDERS = tuple(f.name for f in fields(Vocabulary) if f.name.endswith("_bands"))
RULE_LADDERS = (*(f.name for f in fields(Vocabulary) if f.type == "tuple[Rule, ...]"), *OWN_LADDERS)


class BadRules(ValueError):
    """A rule table that can't be used."""


def rule_rows(vocab: Vocabulary = DEFAULT_VOCABULARY) -> list[tuple]:
    """All ladders of a vocabulary as rows of ``SCHEMA``."""
    rows: list[tuple] = []
    for ladder in RULE_LADDERS:
        for place, rule in enumerate(getattr(vocab, ladder), 1):
            tests = [(t.field, t.op, [str(x) for x in t.values]) for t in rule.tests]
            rows.append((ladder, place, rule.label, rule.keep, tests, None, None))
    for ladder in BAND_LADDERS:
        rows += [(ladder, place, b.label, None, None, b.low, b.high) for place, b in enumerate(getattr(vocab, ladder), 1)]
    return rows


def rule_table(spark: SparkSession, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return spark.createDataFrame(rule_rows(vocab), SCHEMA)


_VALUES = {"like": None, "unlike": None, "isin": None, "above": 1, "is_null": 0}


def _test(ladder: str, row) -> Test:
    if row.op not in _VALUES or (_VALUES[row.op] is not None and len(row["values"] or ()) != _VALUES[row.op]) or (row.op != "is_null" and not row["values"]):
        raise BadRules(f"{ladder}: test {row.op!r} with {len(row['values'] or ())} values")
    return Test(row.field, row.op, tuple(int(x) if row.op == "above" else x for x in row["values"] or ()))


def vocabulary_of(table: DataFrame, base: Vocabulary = DEFAULT_VOCABULARY) -> Vocabulary:
    """``base`` with the ladders that stand in ``table`` replaced as a whole; ladders that don't, stay."""
    rows = table.select("ladder", "place", "label", "keep", "tests", "low", "high").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise BadRules(f"more than {MOST_ROWS} rules")
    ladders: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.ladder or "", r.place or 0)):
        if r.ladder not in BAND_LADDERS and r.ladder not in RULE_LADDERS:
            raise BadRules(f"unknown ladder {r.ladder!r}")
        held = ladders.setdefault(r.ladder, [])
        if r.place != len(held) + 1:
            raise BadRules(f"{r.ladder}: places must run from 1 without gaps or repeats")
        if r.ladder in BAND_LADDERS:
            if r.label is None or (r.low is None and r.high is None):
                raise BadRules(f"{r.ladder}: a band needs a label and an edge")
            held.append(Band(r.label, r.low, r.high))
        elif not r.tests or (r.label is None) == (r.keep is None):
            raise BadRules(f"{r.ladder}: a rule needs tests, and either a label or a field to keep")
        else:
            held.append(Rule(r.label, tuple(_test(r.ladder, t) for t in r.tests), r.keep))
    return replace(base, **{OWN_LADDERS.get(name, name): tuple(held) for name, held in ladders.items()})


# --- what holds whatever the data -----------------------------------------------------------------------


def pattern_within(inner: str, outer: str) -> bool:
    """Whether every text that LIKE ``inner`` matches is matched by ``outer``; False where that can't be told.

    ``inner`` is taken as a text whose own ``%`` only a ``%`` of ``outer`` can cover, and whose ``_`` a ``_`` or ``%``.
    """
    reached = {0}
    closure = lambda places: {j for i in places for j in range(i, i + 1 + len(outer[i:]) - len(outer[i:].lstrip("%")))}
    reached = closure(reached)
    for c in inner:
        after = set()
        for i in reached:
            o = outer[i] if i < len(outer) else ""
            if o == "%":
                after.add(i)
            elif o and c != "%" and (o == "_" or o == c):
                after.add(i + 1)
        reached = closure(after)
    return len(outer) in reached


def implies(a: Test, b: Test) -> bool:
    """Whether ``b`` holds wherever ``a`` does; both test the same field."""
    within = lambda values, patterns: all(any(pattern_within(v, p) for p in patterns) for v in values)
    if a.op == b.op == "isin":
        return set(a.values) <= set(b.values)
    if a.op in ("isin", "like") and b.op == "like":
        return within(a.values, b.values)
    if a.op == "isin" and b.op == "unlike":
        return not any(pattern_within(v, p) for v in a.values for p in b.values)
    if a.op == b.op == "unlike":
        return within(b.values, a.values)
    if a.op == b.op == "above":
        return a.values[0] >= b.values[0]
    return a.op == b.op == "is_null"


def excludes(a: Test, b: Test) -> bool:
    """Whether ``a`` and ``b``, tests of the same field, can't both hold; False where that can't be told."""
    if (a.op == "is_null") != (b.op == "is_null"):
        return True
    if a.op == b.op == "isin":
        return not set(a.values) & set(b.values)
    for x, y in ((a, b), (b, a)):
        if x.op == "isin" and y.op == "like":
            return not any(pattern_within(v, p) for v in x.values for p in y.values)
        if x.op in ("isin", "like") and y.op == "unlike":
            return all(any(pattern_within(v, p) for p in y.values) for v in x.values)
    return False


class Finding(NamedTuple):
    ladder: str
    place: int | None
    label: str | None
    kind: str
    because: str


def dead_rules(ladder: str, rules: Sequence[Rule], given: Sequence[Test] = ()) -> list[Finding]:
    """Rules that no row can reach: they contradict themselves or what holds of all rows (``given``), or an earlier rule takes all."""
    found = []
    for place, rule in enumerate(rules, 1):
        every = [*rule.tests, *given]
        clash = next(((a, b) for i, a in enumerate(every) for b in every[:i] if a.field == b.field and excludes(a, b)), None)
        if clash:
            what = "its input" if any(t in given for t in clash) else "itself"
            found.append(Finding(ladder, place, rule.label, "dead", f"contradicts {what} on {clash[0].field}"))
            continue
        for earlier, other in enumerate(rules[:place - 1], 1):
            if all(any(a.field == b.field and implies(a, b) for a in every) for b in other.tests):
                found.append(Finding(ladder, place, rule.label, "dead", f"rule {earlier} ({other.label}) takes all"))
                break
    return found


def band_faults(ladder: str, bands: Sequence[Band], whole: bool = False) -> list[Finding]:
    """Bands that earlier ones cover, and gaps between bands. ``whole``: the values are whole numbers, so 10 and 11 touch."""
    found, step = [], 1 if whole else 0
    far = float("inf")
    taken: list[tuple[float, float]] = []
    for place, b in enumerate(bands, 1):
        low, high = (-far if b.low is None else b.low), (far if b.high is None else b.high)
        at, covered = low, False
        for lo, hi in sorted(taken):
            if lo > at:
                break
            if hi >= high:
                covered = True
            at = max(at, hi + step)
        if covered:
            found.append(Finding(ladder, place, b.label, "dead", "earlier bands cover it"))
        taken.append((low, high))
    reach = None
    for lo, hi in sorted(taken):
        if reach is not None and lo > reach + step:
            found.append(Finding(ladder, None, None, "gap", f"{reach:g} to {lo:g}"))
        reach = hi if reach is None else max(reach, hi)
    return found


#: What the jobs' own filters leave of the rows that meet a ladder.
GIVEN = {"cancel_route": (Test("cancel_route", "unlike", ("후원자관리팀",)),)}
#: Ladders of bands over whole numbers.
WHOLE = ("tenure_quarter_bands", "tenure_year_bands", "rg_age_bands", "oo_age_bands", "rg_gift_bands", "gift_gap_bands")


def rule_findings(vocab: Vocabulary = DEFAULT_VOCABULARY, given: Mapping[str, Iterable[Test]] = GIVEN) -> list[Finding]:
    """Dead rules, dead bands and gaps of all ladders."""
    found: list[Finding] = []
    for ladder in RULE_LADDERS:
        found += dead_rules(ladder, getattr(vocab, ladder), tuple(given.get(ladder, ())))
    for ladder in BAND_LADDERS:
        found += band_faults(ladder, getattr(vocab, ladder), ladder in WHOLE)
    return found


# --- what the data show -----------------------------------------------------------------------------------


def rule_usage(rows: DataFrame, ladder: str, vocab: Vocabulary = DEFAULT_VOCABULARY, value: str | None = None) -> DataFrame:
    """How many of ``rows`` each rule of a ladder takes: ladder, place, label, rows; place 0 are those that none takes.

    Rules read the fields they name, bands the column ``value``. Rules that take none are in the result with 0 rows.
    """
    held = getattr(vocab, ladder)
    places = [str(i) for i in range(1, len(held) + 1)]
    if ladder in BAND_LADDERS:
        taken = band(F.col(value), [b._replace(label=p) for b, p in zip(held, places, strict=True)], "0")
    else:
        taken = classify([Rule(p, r.tests) for r, p in zip(held, places, strict=True)], otherwise="0")
    counts = rows.groupBy(taken.cast("int").alias("place")).agg(F.count(F.lit(1)).alias("rows"))
    names = [(0, None), *((i, x.label) for i, x in enumerate(held, 1))]
    every = rows.sparkSession.createDataFrame(names, "place int, label string")
    return every.join(counts, "place", "left").select(F.lit(ladder).alias("ladder"), "place", "label", F.coalesce("rows", F.lit(0)).alias("rows"))
