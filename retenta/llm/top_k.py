"""Exact top-k search by inner product with Fagin's threshold algorithm.

The vectors are dealt to shards of bounded size, the queries to groups of bounded size, and each (group, shard) is one
task's work; a query's best of each shard are merged in the end. In a shard every dimension has its values in sorted
order. A query reads all its dimensions' lists side by side, from the end that its sign favours, and scores each vector
as soon as it meets it in any list. The values where the lists have been read to bound the score of all vectors not
met yet; once the bound is below the k-th best score, no other vector can be among the best, or tie with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Vectors in a shard and queries in a group, on average; they set a task's memory and how often rows are shuffled.
SHARD, GROUP = 8192, 8192
#: How far the lists are read at first, and how many times further in each round.
FIRST, FURTHER = 16, 4
LONG = (1 << 63) - 1


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers, short ones filled up with 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Lists:
    """The sorted lists of a shard: rows 0 .. m-1 rise, rows m .. 2m-1 fall."""

    def __init__(self, vectors: np.ndarray):
        order = np.argsort(vectors, axis=0, kind="stable").T
        self.vectors, self.width = vectors, vectors.shape[1]
        self.order = np.concatenate([order, order[:, ::-1]])
        self.values = np.take_along_axis(np.concatenate([vectors.T, vectors.T]), self.order, axis=1)

    def best(self, query: np.ndarray, k: int, own: int | None, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of the k highest scores (ties to the smaller ``tie``) and the scores, without row ``own``; how many rows were scored."""
        n = len(self.vectors)
        dims = np.flatnonzero(query)
        lists, weights = dims + self.width * (query[dims] > 0), query[dims]
        seen = np.zeros(n, bool)
        if own is not None:
            seen[own] = True
        rows, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        read, scored, to = 0, 0, FIRST if len(dims) else n
        while True:
            to = min(to, n)
            met = np.zeros(n, bool)
            met[self.order[lists, read:to].ravel() if len(dims) else np.arange(n)] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            scored += len(new)
            rows, scores = np.append(rows, new), np.append(scores, self.vectors[new] @ query)
            if len(rows) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
                high = np.flatnonzero(scores >= least)
                high = high[np.lexsort((tie[rows[high]], -scores[high]))[:k]]
                rows, scores = rows[high], scores[high]
            if to == n or len(rows) == k and self.values[lists, to - 1] @ weights < scores.min():
                break
            read, to = to, to * FURTHER
        order = np.lexsort((tie[rows], -scores))
        return rows[order], scores[order], scored


def _exact(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if no score can leave them, else as Python integers."""
    bits = sum(np.log2(max(x, 1)) for x in (np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0), vectors.shape[1]))
    if bits < 62:
        return vectors.astype(np.int64), queries.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(vectors), whole(queries)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double, which is a whole number; null for vectors that take no part."""
    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)

    odd = F.exists(F.transform(vector, one), lambda y: F.coalesce(F.isnan(y) | (F.abs(y) == float("inf")), F.lit(True)))
    return F.when(~odd, F.transform(vector, one))


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, space: Workspace, k: int = 5, scale: int = 256, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best vectors of each query, by inner product of ``scaled`` components.

    ``vectors`` has vec_id and embedding; ``is_query`` tells from a row's columns whether it is a query too (null: no). All
    rows but the query's own are its candidates, also rows that repeat its id or vector; a query row that is repeated is
    several queries. Ties go to the smaller vec_id, a null vec_id last. Vectors that are null or hold null or non-finite
    components (also once scaled) take no part; missing components count as 0. Scores beyond 64 bits are cut to the largest or
    smallest long, and such scores rank in any order among themselves. Empty tables give an empty result; other columns are not looked at.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    whole = space.stage(whole.where("v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = whole.agg(F.count("*"), F.count_if("query")).first()
    shards, groups = max(1, -(-n // shard)), max(1, -(-n_queries // group))
    part = F.pmod(F.xxhash64("row"), F.lit(shards))
    own_group = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups))
    candidates = whole.select("vec_id", "v", "row", F.lit(False).alias("query"), part.alias("s"), _each(groups).alias("g"))
    queries = whole.where("query").select("vec_id", "v", "row", "query", _each(shards).alias("s"), own_group.alias("g"))

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        asked = table.column("query").to_numpy(zero_copy_only=False)
        if not asked.any() or asked.all():
            return
        v, q = (matrix(table.filter(pa.array(x)).column("v").combine_chunks()) for x in (~asked, asked))
        width = max(v.shape[1], q.shape[1])
        v, q = _exact(_widened(v, width), _widened(q, width))
        ids, rows = table.column("vec_id").to_numpy(zero_copy_only=False), table.column("row").to_numpy()
        place = {r: i for i, r in enumerate(rows[~asked].tolist())}
        tie = np.where(np.isnan(ids[~asked].astype(float)), np.inf, ids[~asked]) if table.column("vec_id").null_count else ids[~asked]
        lists = Lists(v)
        found = [lists.best(x, k, place.get(r), tie)[:2] for x, r in zip(q, rows[asked].tolist(), strict=True)]
        counts = [len(f[0]) for f in found]
        at = np.concatenate([f[0] for f in found])
        score = [max(-LONG - 1, min(LONG, int(x))) for f in found for x in f[1]]
        of = np.repeat(np.flatnonzero(asked), counts)
        source = table.column("vec_id")
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[of]), source.take(pa.array(of)).combine_chunks(), source.take(pa.array(np.flatnonzero(~asked)[at])).combine_chunks(), pa.array(score, pa.int64())],
            names=["row", "query_id", "vec_id", "score"])

    def of_cell(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(pa.Table.from_batches(list(batches)))

    best = candidates.unionByName(queries).groupBy("g", "s").applyInArrow(of_cell, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
