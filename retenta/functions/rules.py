"""Rule tables: ordered (tests, label) rows folded into one CASE expression, first match wins.

A test that meets NULL is unknown and so does not match, as in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Test(NamedTuple):
    __test__ = False  # not a pytest class

    field: str
    op: str
    values: tuple


def like(field: str, *patterns: str) -> Test:
    return Test(field, "like", patterns)


def unlike(field: str, *patterns: str) -> Test:
    """None of the patterns match."""
    return Test(field, "unlike", patterns)


def isin(field: str, *values: str) -> Test:
    return Test(field, "isin", values)


def same(field: str, value: str) -> Test:
    return Test(field, "isin", (value,))


def above(field: str, value: int) -> Test:
    return Test(field, "above", (value,))


def is_null(field: str) -> Test:
    return Test(field, "is_null", ())


@dataclass(frozen=True)
class Rule:
    """``label`` applies where all tests hold. With ``keep`` the named field's own text is the result."""

    label: str | None
    tests: tuple[Test, ...]
    keep: str | None = None

    @classmethod
    def of(cls, label: str | None, *tests: Test, keep: str | None = None) -> Rule:
        return cls(label, tests, keep)


class Band(NamedTuple):
    """Closed numeric range; None leaves that side open."""

    label: str
    low: int | None
    high: int | None


def one_of_like(column: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.like(p) for p in patterns])


def _holds(test: Test, fields: Mapping[str, Column]) -> Column:
    column = fields[test.field]
    if test.op == "like":
        return one_of_like(column, test.values)
    if test.op == "unlike":
        return ~one_of_like(column, test.values)
    if test.op == "isin":
        return column.isin(*test.values)
    if test.op == "above":
        return column > test.values[0]
    if test.op == "is_null":
        return column.isNull()
    raise ValueError(f"unknown test {test.op!r}")


def classify(
    rules: Sequence[Rule], fields: Mapping[str, Column] | None = None, otherwise: Column | str | None = None
) -> Column:
    """One CASE over the rule table. ``fields`` maps the names in the tests to columns (default: same name)."""
    names = {t.field for r in rules for t in r.tests} | {r.keep for r in rules if r.keep}
    columns = {n: F.col(n) for n in names} | dict(fields or {})
    ladder = F
    for rule in rules:
        condition = reduce(lambda a, b: a & b, [_holds(t, columns) for t in rule.tests])
        ladder = ladder.when(condition, columns[rule.keep] if rule.keep else rule.label)
    return ladder.otherwise(otherwise)


def band(value: Column, bands: Sequence[Band], otherwise: str | None = None) -> Column:
    """Label of the first band that holds the value; NULL and gaps between bands fall to ``otherwise``."""
    ladder = F
    for label, low, high in bands:
        if low is None:
            inside = value <= high
        elif high is None:
            inside = value >= low
        else:
            inside = value.between(low, high)
        ladder = ladder.when(inside, label)
    return ladder.otherwise(otherwise)


def rank_map(label: Column, order: Sequence[str], default: int = 999) -> Column:
    """1-based place of a label in a fixed order, for report sorting."""
    ladder = F
    for place, name in enumerate(order, start=1):
        ladder = ladder.when(label == name, place)
    return ladder.otherwise(default)
