"""Text helpers on columns, built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_key(campaign: Column) -> Column:
    """First two ``/`` parts joined; NULL if there are fewer than two."""
    parts = F.split(campaign, "/")
    return F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def matches_any(text: Column, words: Sequence[str]) -> Column:
    """True where the lower-cased text holds one of the words, taken literally; NULL text gives NULL."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])


def part_from_right(text: Column, n: int) -> Column:
    """The n-th part from the right of text split at ``_`` or ``.``.

    NULL for a missing or empty part, and for text with more than four parts.
    """
    parts = F.split(text, "[_.]")
    return F.when(F.size(parts) <= 4, F.nullif(F.try_element_at(parts, F.lit(-n)), F.lit("")))


def zip_class(home: Column, office: Column) -> Column:
    """``old_zip`` if either code is hyphenated, ``new_zip`` if either is plain, '' if both are missing."""
    return (
        F.when(home.like("%-%") | office.like("%-%"), "old_zip")
        .when(~home.like("%-%") | ~office.like("%-%"), "new_zip")
        .otherwise("")
    )


def whole_number(amount: Column) -> Column:
    """Nearest whole number as BIGINT, halves away from zero (a bare cast would cut the fraction)."""
    return F.round(amount).cast("bigint")
