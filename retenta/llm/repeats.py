"""Removing repeated byte strings: hashed buckets at anchors, in place of bucket-pointer refinement, which would refine
q-gram buckets on identifiers of later offsets.

A suffix array would bring all starts of equal strings of ``LENGTH`` bytes together. Here a bucket's identifier is the
hash of its string, the same everywhere, so no numbering is shared. Three ideas keep most positions out of the sort:

1. Initial buckets hold grams of ``GRAM`` bytes, but only at anchors: the least gram (by hash) of each window that a
   string of ``LENGTH`` bytes spans. Equal strings have equal anchors. A start belongs to the anchor of its string; if
   that anchor is alone in its bucket, its starts are unique.
2. A bucket is refined by sorting its anchors on the identifier of all that their starts' strings span. Anchors that
   agree there are repeated with all their starts, which need no further look. One of them stands for all.
3. Only where a bucket still holds an anchor that agrees with none, its starts are refined one by one, on the
   identifiers of their whole strings, together with those of the anchors that stand for others.

Buckets are never gathered: entries are counted by identifier before they are shuffled, and the verdict on an identifier
is joined to its entries, which adaptive execution splits where one has many. The verdicts go back to the texts by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import vectext as v
from .workspace import Workspace

LENGTH, GRAM = 400, 300
#: Starts of grams in a string, the window of an anchor.
WINDOW = LENGTH - GRAM + 1
#: Starts that are counted together before they are shuffled.
FLUSH = 1 << 20
#: An order of grams: the upper bits of their hash, then their place. A piece may have 2**28 bytes.
_PLACE_BITS = 28
UNRESOLVED, RESOLVED, STANDS = 0, 1, 2


@dataclass
class Anchors:
    """Anchors of a piece: place, first and last start that belong to each, and its text."""

    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


class Hashes:
    """Hashes of any byte spans of a buffer."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, v.U64)
        np.cumsum(v.BYTE_VALUES[buf] * v.powers(v._BASE, len(buf)), out=self.sums[1:])
        self.inverse = v.powers(v._INVERSE, len(buf) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return v.mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(v.U64), 51)


def anchors(t: v.Texts, h: Hashes) -> Anchors:
    n = len(t.buf)
    ends = np.diff(t.offsets) - LENGTH + 1
    long = np.flatnonzero(ends > 0)
    if not len(long):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none)
    grams = n - GRAM + 1
    place = np.arange(grams)
    order = (h.of(place, place + GRAM) >> v.U64(_PLACE_BITS) << v.U64(_PLACE_BITS)) | place.astype(v.U64)
    # Least of each window: of the rest of a block from its start on, and of the next block up to its end.
    padded = np.full(-(-grams // WINDOW) * WINDOW, np.iinfo(v.U64).max, v.U64)
    padded[:grams] = order
    blocks = padded.reshape(-1, WINDOW)
    up_to = np.minimum.accumulate(blocks, axis=1).ravel()
    from_on = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.repeat(t.offsets[long] - np.cumsum(ends[long]) + ends[long], ends[long]) + np.arange(ends[long].sum())
    doc = np.repeat(long, ends[long])
    least = (np.minimum(from_on[starts], up_to[starts + WINDOW - 1]) & v.U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return Anchors(least[at], starts[at], starts[np.append(at[1:], len(starts)) - 1], doc[at])


def _numbers(doc: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its text; entries are sorted by text."""
    first = np.searchsorted(doc, doc)
    return np.arange(len(doc)) - first


def anchor_verdicts(entries: DataFrame, space: Workspace) -> DataFrame:
    """row, k and verdict of the entries (gram, all, row, k) of anchors that share their gram."""
    shared = entries.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    entries = space.stage(entries.join(shared.hint("merge"), "gram"), "shared")
    groups = space.stage(entries.groupBy("gram", "all").agg(F.count("*").alias("n"), F.min(F.struct("row", "k")).alias("first")), "groups")
    open_ = groups.where("n = 1").select("gram").distinct().withColumn("open", F.lit(True))
    judged = space.stage(groups.join(open_.hint("merge"), "gram", "left"), "judged")
    stands = F.col("open") & (F.struct("row", "k") == F.col("first"))
    verdict = F.when(F.col("n") == 1, UNRESOLVED).when(stands, STANDS).otherwise(RESOLVED)
    return entries.join(judged.hint("merge"), ["gram", "all"]).select("row", "k", verdict.alias("verdict"))


def _verdicts(batch: pa.RecordBatch, t: v.Texts, a: Anchors) -> np.ndarray:
    """The verdict on each anchor of a piece, -1 for those alone in their bucket."""
    out = np.full(len(a.place), -1, np.int64)
    column = batch.column("anchors").slice(t.first, len(t))
    flat = column.flatten()
    doc = np.repeat(np.arange(len(t)), column.value_lengths().to_numpy(zero_copy_only=False))
    first = np.searchsorted(a.doc, np.arange(len(t)))
    out[first[doc] + flat.field("k").to_numpy()] = flat.field("verdict").to_numpy()
    return out


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[which], which


def without_repeats(docs: DataFrame, space: Workspace) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed, in all its places.
    Null texts are empty; texts shorter than ``LENGTH`` stay whole; rows that repeat are copies of each other, with
    the same or another doc_id. An empty table gives an empty one; other columns are not looked at. A row is known by
    its place, so ``docs`` is written first unless it is a table of files.
    """
    docs = space.stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "documents")

    def anchor_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                h = Hashes(t.buf)
                a = anchors(t, h)
                gram = h.of(a.place, a.place + GRAM)
                shape = ((a.place - a.first) << 8 | (a.place - a.last)).astype(v.U64)
                all_ = v.mix(h.of(a.first, a.last + LENGTH) ^ v.mix(shape, 53))
                # As monotonically_increasing_id() numbers rows.
                row = (TaskContext.get().partitionId() << 33) + n + a.doc
                n += len(t)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(all_.view(np.int64)), pa.array(row), pa.array(_numbers(a.doc).astype(np.int32))], ["gram", "all", "row", "k"])

    entries = space.stage(docs.mapInArrow(anchor_entries, "gram long, all long, row long, k int"), "anchors")
    judged = anchor_verdicts(entries, space)
    by_row = judged.groupBy("row").agg(F.collect_list(F.struct("k", "verdict")).alias("anchors"))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    active = space.stage(numbered.select("row", "text").join(by_row, "row"), "active")

    def starts_of(batch: pa.RecordBatch, t: v.Texts, verdicts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the starts of anchors with these verdicts: key of the string, text, place in it, and whether it asks."""
        h = Hashes(t.buf)
        a = anchors(t, h)
        verdict = _verdicts(batch, t, a)
        look = np.flatnonzero(np.isin(verdict, verdicts))
        starts, which = _ranges(a.first[look], a.last[look])
        doc = a.doc[look][which]
        return h.of(starts, starts + LENGTH).view(np.int64), doc, starts - t.offsets[doc], (verdict[look] == UNRESOLVED)[which]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asks, n = [], [], 0

        def report() -> pa.RecordBatch:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            asking = np.bincount(back, weights=np.concatenate(asks)).astype(np.int64)
            return pa.record_batch([pa.array(key), pa.array(np.bincount(back)), pa.array(asking)], ["key", "n", "asks"])

        for batch in batches:
            for t in v.pieces(batch.column("text")):
                key, _, _, ask = starts_of(batch, t, (UNRESOLVED, STANDS))
                keys.append(key)
                asks.append(ask)
                n += len(key)
                if n >= FLUSH:
                    yield report()
                    keys, asks, n = [], [], 0
        if n:
            yield report()

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                key, doc, at, _ = starts_of(batch, t, (UNRESOLVED,))
                row = batch.column("row").slice(t.first, len(t)).to_numpy()
                yield pa.record_batch([pa.array(key), pa.array(row[doc]), pa.array(at.astype(np.int32))], ["key", "row", "at"])

    sums = active.mapInArrow(counted, "key long, n long, asks long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("asks").alias("asks"))
    again = space.stage(sums.where("n > 1 and asks > 0").select("key"), "again")
    found = active.mapInArrow(asking, "key long, row long, at int").join(again.hint("merge"), "key").groupBy("row").agg(F.collect_list("at").alias("starts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                a = anchors(t, Hashes(t.buf))
                covered = np.zeros(len(t.buf) + 1, np.int64)
                whole = np.flatnonzero(_verdicts(batch, t, a) > UNRESOLVED)
                np.add.at(covered, a.first[whole], 1)
                np.add.at(covered, a.last[whole] + LENGTH, -1)
                starts = batch.column("starts").slice(t.first, len(t))
                doc = np.repeat(np.arange(len(t)), starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                at = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + t.offsets[doc]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + LENGTH, -1)
                gone = np.cumsum(covered)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                inner = np.ones(len(gone), bool)
                inner[t.offsets[:-1][t.offsets[:-1] < len(gone)]] = False
                opens[1:] &= ~(gone[:-1] & inner[1:])
                spans = np.concatenate([[0], np.cumsum(opens)])
                lo, hi = t.offsets[:-1], t.offsets[1:]
                kept = [hashlib.sha256(t.buf[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(lo, hi, strict=True)]
                yield pa.record_batch([batch.column("row").slice(t.first, len(t)), pa.array(sums[hi] - sums[lo]), pa.array(spans[hi] - spans[lo]), pa.array(kept)],
                                      ["row", "n_removed", "n_spans", "kept"])

    changed = active.join(found, "row", "left").mapInArrow(remove, "row long, n_removed long, n_spans long, kept string")
    whole = numbered.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return whole.join(changed, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"))
