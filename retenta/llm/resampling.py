"""Importance resampling towards a target corpus.

Each document and each target text is a bag of hashed n-grams. A bucket's gain is the log of its share in the target
over its share in the documents; a document's weight is the mean gain of its n-grams. Documents are drawn without
replacement in proportion to the exponential of their weights by adding Gumbel noise, which is hashed from the id, and
taking the highest sums.

The n-grams of a piece of texts are interned in an open-addressed table (``ngram_table``): buckets and counts are worked
out once for each distinct n-gram of the piece, and the occurrences, which know their slots, gather the gains. Only
counts by bucket are shuffled, and the gains, one number a bucket, are sent to the workers. The highest sums are found by
dealing the documents by ranges of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as v
from .ngram_table import interned, spans
from .places import numbered
from .workspace import Workspace

BUCKETS, LONGEST = 10_000, 2


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket and n (its n-grams in all texts, repeats counted), for buckets with any. Null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in v.pieces(batch.column(0)):
                table = interned(spans(t, longest), buckets)
                found += np.bincount(table.bucket[table.used], table.count[table.used], buckets).astype(np.int64)
        on = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(found[on])], names=["bucket", "n"])

    return texts.select(F.col(f"`{column}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of every bucket, from two tables of ``bucket_counts``."""
    of = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = of.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row for a bucket
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in found:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the n-grams; without any: 0) of each row."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                s = spans(t, longest)
                table = interned(s, buckets)
                n = v.per_doc(s.doc, len(t))
                total = np.zeros(len(t), np.int64)
                np.add.at(total, s.doc, gains[table.bucket][table.slot])
                arrays = [pa.array(x) for x in (s.n_words, n, total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(t.first, len(t)), *arrays], names=["doc_id", "n_words", "n_features", "weight"])

    of = docs.select(F.col("`doc_id`"), F.col("`text`"))
    return of.mapInArrow(weigh, f"doc_id {of.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a standard Gumbel number hashed from seed and id); a null id counts as the text null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, space: Workspace, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text), drawn towards the texts of ``target`` (text).

    Columns: doc_id, n_features, weight, score, rank. Of the documents with ``least_words`` words or more, ``percent``
    in a hundred (rounded down) are drawn: rank 1, 2, ... by falling score, then rising id (null last); rank is null for the
    rest. A null text is empty; it has no features and weight 0. Each row is a document of its own, also if ids or whole
    rows repeat: equal ids share the noise, and of rows equal in score and id the one with more features comes first.
    Empty tables give an empty result (no target: the gains are those of an empty one). Other columns are not looked at.
    A single text must fit a worker some 60 times over.
    """
    docs = space.stored(docs, "docs")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    scored = weighed(docs, gains).withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "short": (F.col("n_words") < least_words).cast("int")})
    order = ["short", F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    scored = space.stage(scored, "scored")  # dealing by ranges looks at its input twice
    drawn = scored.where("short = 0").count() * percent // 100
    placed = numbered(scored, [], order, space, "dealt", "place")
    rank = F.when((F.col("short") == 0) & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, space: Workspace, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` whose ids are drawn, with all columns. Rows that share an id are taken together; null ids are not taken."""
    ids = space.stage(resampled(docs, target, space, percent, least_words, seed).where("rank is not null").select("doc_id").distinct(), "drawn")
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)
