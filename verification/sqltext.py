"""Small SQL text builders for the oracle: the fixed rule tables as CASE text, lists and key expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from retenta.functions import Band, Rule


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def any_like(column: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{column} LIKE {quoted(p)}" for p in patterns) + ")"


def rule_case(rules: Sequence[Rule], fields: Mapping[str, str] | None = None, otherwise: str = "NULL") -> str:
    names = dict(fields or {})
    parts = []
    for rule in rules:
        tests = []
        for field, op, values in rule.tests:
            column = names.get(field, field)
            tests.append({
                "like": lambda: any_like(column, values),
                "unlike": lambda: f"NOT {any_like(column, values)}",
                "isin": lambda: f"{column} IN {listed(values)}",
                "above": lambda: f"{column} > {values[0]}",
                "is_null": lambda: f"{column} IS NULL",
            }[op]())
        result = names.get(rule.keep, rule.keep) if rule.keep else "NULL" if rule.label is None else quoted(rule.label)
        parts.append(f"WHEN {' AND '.join(tests)} THEN {result}")
    return f"CASE {' '.join(parts)} ELSE {otherwise} END"


def band_case(value: str, bands: Sequence[Band], otherwise: str = "NULL") -> str:
    parts = []
    for label, low, high in bands:
        edges = [f"{value} >= {low}"] if low is not None else []
        edges += [f"{value} <= {high}"] if high is not None else []
        parts.append(f"WHEN {' AND '.join(edges)} THEN {quoted(label)}")
    return f"CASE {' '.join(parts)} ELSE {otherwise} END"


def order_case(label: str, order: Sequence[str]) -> str:
    places = ", ".join(quoted(x) for x in order)
    return f"CAST(coalesce(nullif(coalesce(list_position([{places}], {label}), 0), 0), 999) AS INTEGER)"


def key_sql(campaign: str) -> str:
    return f"string_split({campaign}, '/')[1] || string_split({campaign}, '/')[2]"


def rounded_mean(cents: str, count: str) -> str:
    """Mean of a sum of cents in whole units, halves up, in whole-number arithmetic (amounts are positive)."""
    return f"((2 * ({cents}) + 100 * ({count})) // nullif(200 * ({count}), 0))"


def cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS BIGINT)"
