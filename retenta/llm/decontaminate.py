"""Benchmark decontamination: which documents hold a test item, by share of the item's shingles (built-in functions only).

Containment search with MinHash sketches, partitioned by size. Items with 2**p to 2**(p+1) - 1 distinct shingles of
five words form partition p. An item's sketch is its bottom k_p shingles in hash order, with k_p = 8 + the most
shingles an item of that partition may miss at the wanted containment. So a document that holds enough of an item
meets its sketch at least 8 times (or wholly, if the sketch is the whole item): no such pair is lost. A document is
any length; it is searched whole. Pairs that meet the sketch often enough are verified on all shingles.

The small side of each join is a written table of known size; Spark broadcasts it if it is small and shuffles both
sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Sketch shingles beyond those that an item may miss.
SURE_HITS = 8
BLANKS = " \t\n\x0b\x0c\r"


def word_shingles(text: Column, k: int = 5) -> Column:
    """Distinct hashes of the runs of ``k`` lower-cased words; empty for null and for texts of fewer words."""
    words = F.split(F.trim(F.lower(text), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        first = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k))
        return F.transform(first, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    # The array of word hashes is bound once; written out it would be computed anew for every shingle.
    return F.array_distinct(F.flatten(F.transform(F.array(hashes), runs)))


def item_sketches(items: DataFrame, share: float = 0.8, k: int = 5) -> DataFrame:
    """Per item and shingle: item_id, n_item, sketch size, hash, and whether the hash is in the sketch.

    Rows that repeat an item_id count as one item. Items of fewer than ``k`` words have no shingle and no row.
    """
    each = items.select("item_id", F.explode(word_shingles(F.col("text"), k)).alias("h")).distinct()
    by_item = Window.partitionBy("item_id")
    n = F.col("n_item")
    upper = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    sketch = F.least(n, (F.floor(upper * (1 - share) + 1e-9) + SURE_HITS).cast("long"))
    return (
        each.withColumn("n_item", F.count("*").over(by_item)).withColumn("sketch", sketch)
        .withColumn("in_sketch", F.row_number().over(by_item.orderBy("h")) <= F.col("sketch"))
    )


def contaminated(docs: DataFrame, items: DataFrame, space: Workspace, share: float = 0.8, k: int = 5) -> DataFrame:
    """One row per document and item with at least ``share`` of the item's shingles in the document.

    Columns: doc_id, item_id, n_item and n_shared (distinct shingles), containment. Null and empty texts, and texts
    or items of fewer than ``k`` words, match nothing; rows that repeat a doc_id count as one document; null ids are
    ids like any other; an empty table on either side gives no rows. Other columns are not looked at.
    """
    sketches = space.stage(item_sketches(items, share, k), "items")
    probe = space.stage(sketches.where("in_sketch").select("item_id", "n_item", "sketch", "h"), "probe")
    shingled = docs.select("doc_id", F.explode(word_shingles(F.col("text"), k)).alias("h"))
    may_miss = F.col("n_item") - F.ceil(F.col("n_item") * share - 1e-9)
    met = (
        shingled.join(probe, "h").groupBy("doc_id", "item_id", "n_item", "sketch").agg(F.count_distinct("h").alias("hits"))
        .where(F.col("hits") >= F.col("sketch") - may_miss)
    )
    met = space.stage(met, "met")
    whole = met.where("sketch = n_item").select("doc_id", "item_id", "n_item", F.col("hits").alias("n_shared"))
    # Sketched pairs are counted on all shingles: only their documents are read, and of those only items' shingles.
    part = met.where("sketch < n_item").select("doc_id", "item_id")
    asked = space.stage(part.select(F.col("doc_id").alias("asked")).distinct(), "asked")
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi")
    longer = space.stage(sketches.where("sketch < n_item").select("item_id", "n_item", "h"), "longer")
    shared = (
        texts.select("doc_id", F.explode(word_shingles(F.col("text"), k)).alias("h")).join(longer, "h")
        .groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    )
    found = whole.unionByName(shared).where(F.col("n_shared") >= F.ceil(F.col("n_item") * share - 1e-9))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, space: Workspace, share: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    leaks = space.stage(contaminated(docs, items, space, share).select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak")), "left_anti")
