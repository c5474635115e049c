"""Joins the jobs share. None carries a broadcast hint: Spark broadcasts a side it has measured to be
small (statically or, with adaptive execution, at run time) and shuffles otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import use_checkpoints

SIEVE_BITS, SIEVE_MOST = 16, 1 << 26


def with_lookup(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, columns: Sequence[str]) -> DataFrame:
    """Left join that adds lookup columns; the lookup's key must be unique."""
    right = lookup.select(F.col(lookup_key).alias("_lookup_key"), *columns)
    return df.join(right, F.col(key) == F.col("_lookup_key"), "left").drop("_lookup_key")


def with_membership(df: DataFrame, members: DataFrame, key: str, member_key: str, name: str) -> DataFrame:
    """Add ``name`` = Y if the key is in the list, else N. Repeated members do not repeat rows."""
    right = members.select(F.col(member_key).alias("_member")).filter(F.col("_member").isNotNull()).distinct()
    return (
        df.join(right, F.col(key) == F.col("_member"), "left")
        .withColumn(name, F.when(F.col("_member").isNotNull(), "Y").otherwise("N"))
        .drop("_member")
    )


def sieved(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose key is not in ``wanted``, a stored table of one column, for an exact join to follow.

    Each wanted key sets one bit, its hash, in an array of at least ``SIEVE_BITS`` bits a key; rows whose bit is not set are
    left out, NULL keys maybe. As a filter by a subquery it goes down to the scan, below the joins and shuffles that ``df``
    is made by. The array has at most ``SIEVE_MOST`` bits (8 MB), however many keys are wanted: beyond that more rows pass.
    """
    bits = min(1 << (SIEVE_BITS * max(wanted.count(), 64) - 1).bit_length(), SIEVE_MOST)

    def place(column: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(column), F.lit(bits))
        return F.floor(at / 64).cast("int"), F.pmod(at, F.lit(64)).cast("int")

    word, bit = place(wanted.columns[0])
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))
    found = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_set"))
    every = wanted.sparkSession.range(bits // 64).join(found, F.col("id") == F.col("_word"), "left")
    words = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_set", F.lit(0).cast("bigint")).alias("set")))).alias("_all"))
    word, bit = place(key)
    return df.filter(F.getbit(F.get(words.select(F.col("_all.set")).scalar(), word), bit) == 1)


def follow_merges(links: DataFrame) -> DataFrame:
    """Final survivor of every merged member, through chains of merges.

    ``links`` holds (merged_member_no, surviving_member_no). Each round replaces a survivor that was
    itself merged later by its own survivor, so the followed length doubles: a chain of n merges takes
    about log2(n) joins. Rounds are written with ``checkpoint()``, so a lost executor cannot undo them.
    Ids that merge in a circle have no survivor and raise ValueError.
    """
    use_checkpoints(links.sparkSession)
    current = links.select("merged_member_no", "surviving_member_no").distinct().checkpoint()
    limit = max(current.count(), 1).bit_length() + 1
    for _ in range(limit):
        later = current.select(
            F.col("merged_member_no").alias("_via"), F.col("surviving_member_no").alias("_next")
        )
        joined = current.join(later, F.col("surviving_member_no") == F.col("_via"), "left").checkpoint()
        if joined.filter(F.col("_via").isNotNull()).isEmpty():
            return current
        current = joined.select(
            "merged_member_no", F.coalesce("_next", "surviving_member_no").alias("surviving_member_no")
        ).distinct()
    raise ValueError("merge history holds a circle of member numbers")
