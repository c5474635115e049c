"""Mixing sources to target weights.

Words are added up per source, which gives each source a repetition rate (target / size). A document is emitted
floor(rate) times, and once more if a number in [0, 1) hashed from a seed, its id, its text and its place among the rows
equal in these and the source lies below the rate's fraction. Only sums per source are gathered; a source may hold any
share of the rows, and so may rows without an id or with the same one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import numbered
from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_share(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with ``target``, the words the mix should take of each.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share the sum of all sizes. No target
    exceeds ``most`` times its source's size; the excess goes to the others by weight, until none is above. In order
    of most * size / weight the capped sources come first, so running sums settle it without iteration.
    """
    k = len(weights)
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % k
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w, cap = F.col("weight"), F.col("cap")
    level = (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.col("weights") - F.coalesce(F.sum(w).over(before), F.lit(0)))
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long"))
        .withColumns({"cap": F.lit(most) * F.col("source_size"), "total": F.sum("source_size").over(everything)})
        .withColumns({"weights": F.sum("weight").over(everything), "ratio": cap / w})
    )
    judged = ranked.withColumn("capped", F.col("ratio") < level)
    taken = lambda x: F.coalesce(F.sum(F.when(F.col("capped"), x)).over(everything), F.lit(0))
    rest = w * (F.col("total") - taken(cap)).cast("double")
    share = F.try_divide(rest, F.col("weights") - taken(w))
    return judged.select("source", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


ROW_KEY = ["doc_id", "source", "digest"]


def _with_place(rows: DataFrame, space: Workspace) -> DataFrame:
    """``rows`` (with ROW_KEY) with ``place``, from 1 among the rows of a key; which of them has which does not matter.

    Only rows that repeat a key are numbered, by ranges, so a key may hold most of them. The others keep their place in
    the plan and are not shuffled for it, unless repeated keys are many.
    """
    repeated = rows.groupBy(*ROW_KEY).agg(F.count("*").alias("n")).where("n > 1")
    repeated = space.stage(repeated.select(*[F.col(c).alias(f"r_{c}") for c in ROW_KEY], F.lit(True).alias("repeated")), "repeated")
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in ROW_KEY]
    marked = rows.join(repeated, same, "left").drop(*[f"r_{c}" for c in ROW_KEY])
    single = marked.where("repeated is null").drop("repeated").withColumn("place", F.lit(1).cast("long"))
    if repeated.isEmpty():
        return single
    several = numbered(marked.where("repeated").drop("repeated"), ROW_KEY, [], space, "several", "place").drop("part", "salt")
    return single.unionByName(several)


def _copies(seed: int) -> Column:
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    share = hashed_share(seed, F.col("doc_id"), F.col("digest"), F.col("place"))
    return F.floor(rate).cast("int") + (share < rate - F.floor(rate)).cast("int")


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def mixing_plan(docs: DataFrame, space: Workspace, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies and taken (words the mix takes).

    Null and empty texts have size 0 and belong to their source; a null source is one of its own. Rows that repeat a
    doc_id, or have none, draw by their texts; rows equal in id, text and source each draw for themselves. An empty table gives
    an empty one. Other columns of ``docs`` are not looked at. Sizes are written once, so that the words are counted in one scan.
    """
    sized = space.stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _digest().alias("digest")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = space.stage(source_targets(sizes, weights, most).withColumnRenamed("source", "of"), "targets")
    return (
        _with_place(sized, space).join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(seed))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, space: Workspace, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """``docs`` with each row as often as ``mixing_plan`` takes it. All columns stay as they are, whatever their names.

    Nulls, repeated rows and empty tables: as there.
    """
    sizes = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    targets = space.stage(source_targets(sizes, weights, most).withColumnRenamed("source", "of"), "targets")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", _digest().alias("digest"))
    return (
        _with_place(row, space).join(targets, F.col("source").eqNullSafe(F.col("of")))
        .select("row", F.explode(F.array_repeat(F.lit(1), _copies(seed)))).select("row.*")
    )
