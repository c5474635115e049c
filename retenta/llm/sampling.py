"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, columns: list[str]) -> DataFrame:
    """doc_id, ``columns`` of ``docs`` and y (0 or 1) of at most ``most`` labelled documents, chosen by hash of the id.

    ``learn`` says which ids of ``labels`` may be learnt from. Null labels are left out; of several labels of an id the
    highest counts. The chosen ids are few by construction, so they are broadcast to the documents.
    """
    ids = labels.where(F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "of")
    return docs.select("doc_id", *columns).join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).drop("of")
