"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are runs of five lower-cased words, weighted by their number in the text times an inverse document frequency.
Every text gets 132 consistent weighted samples, taken bin-wise. A shingle is split into elements that weigh 1 and one
for what is left, so that no bin gets more weight than others by a heavy shingle; the elements two texts share weigh
just what the shingles share. An element's hash sends it to one bin, and a bin keeps the element that improved
consistent weighted sampling picks there; a bin that got none samples all elements with draws of its own. Texts that agree on all six samples of one of 22 bands share a bucket; those at a similarity of 0.8
share one with a probability of 0.9988, at 0.85 of 0.99998.

Within a bucket no pairs are listed: members are compared with a pivot, the member whose buckets are largest (a text
that others were copied from keeps all its bands, its copies lose some). Similar pairs join their classes. The members
of buckets that then still are of several classes meet by prefix filter: every text's shingles are put in one order,
rare ones first, and two texts at the wanted similarity must share one of the first shingles of both, at places that
leave enough weight behind. Shingles that hold several classes get a pivot each in the same way; at last all pairs of
different classes that pass the filter are compared. So every two members of a bucket, whatever its size, are in one
class, were compared, or can't be similar.

Pairs are first judged on their samples, of which at least ``AGREE`` must be equal (106 are expected at a similarity of
0.8); only then the shingles of both are fetched for the exact weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as v
from .graph import components
from .workspace import Workspace

BANDS, ROWS = 22, 6
BINS = BANDS * ROWS
#: Equal samples that a pair needs to be verified: five standard errors below those expected at 0.8.
AGREE = 82
#: Cells that shingles are counted in to put rare ones first. The order decides on the work, not on the result.
CELLS = 1 << 20
#: Shingles in at least this share of the documents have a document frequency; rarer ones all weigh 1.
FREQUENT = 0.01
#: The weight of a shingle that is in every document. Near copies of one text that make up much of the corpus must
#: stay near copies, so what they share may not lose much weight.
LEAST_IDF = 0.7
#: Texts whose shingles are counted together in the search for frequent ones.
GROUP_TEXTS, GROUP_SHINGLES = 4000, 2 << 20


def text_key(text: Column) -> Column:
    """The key of a text: 16 bytes; null as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _shingle_counts(t: v.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = v.words(t)
    h, doc, _ = v.shingles(w, v.span_hashes(t.buf, w.start, w.end), len(t))
    return v.doc_counts(doc, h)


def frequent_shingles(docs: DataFrame, share: float = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and the shingles in at least ``share`` of them with their document frequencies (sorted by shingle).

    Exact, in two scans. Groups of texts report the shingles in more than a quarter of ``share`` of the group; what
    they leave out is under a quarter of ``share`` of all rows, so shingles reported for three quarters of ``share``
    are a superset. There are at most (mean shingles of a text) / (0.75 * share) of those, whatever the corpus; these
    are counted exactly.
    """
    total = docs.count()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = size = 0

        def report() -> pa.RecordBatch:
            ids, c = np.unique(np.concatenate(held), return_counts=True)
            often = c > share / 4 * n
            return pa.record_batch([pa.array(ids[often].astype(np.int64)), pa.array(c[often].astype(np.int64))], ["h", "c"])

        for batch in batches:
            for t in v.pieces(batch.column(0)):
                ids = _shingle_counts(t)[1]
                held.append(ids)
                n, size = n + len(t), size + len(ids)
                if n >= GROUP_TEXTS or size >= GROUP_SHINGLES:
                    yield report()
                    held, n, size = [], 0, 0
        if n:
            yield report()

    sums = docs.select("text").mapInArrow(local, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    likely = np.array(sorted(r.h for r in sums.where(F.col("c") >= 0.75 * share * total).select("h").collect()), v.U64)
    if not len(likely):
        return total, likely, np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(likely)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        counts = np.zeros(len(ids), np.int64)
        for batch in batches:
            for t in v.pieces(batch.column(0)):
                found = _shingle_counts(t)[1]
                at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
                counts += np.bincount(at[ids[at] == found], minlength=len(ids))
        yield pa.record_batch([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["i", "c"])

    rows = docs.select("text").mapInArrow(exact, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).where(F.col("c") >= share * total).collect()
    rows.sort(key=lambda r: r.i)
    return total, likely[np.array([r.i for r in rows], np.int64)], np.array([r.c for r in rows], np.float64)


class Weights:
    """Inverse document frequencies: 1 for rare shingles, falling with the logarithm to ``LEAST_IDF`` for one in every text."""

    def __init__(self, total: int, ids: np.ndarray, df: np.ndarray, share: float = FREQUENT):
        self.ids = ids
        self.idf = LEAST_IDF + (1 - LEAST_IDF) * np.log(total / np.maximum(df, 1)) / np.log(1 / share)

    def short(self) -> Weights:
        """The same by 32 bits of the shingles."""
        out = Weights.__new__(Weights)
        out.ids, out.idf = (self.ids >> v.U64(8)).astype("<u4"), self.idf
        return out

    def of(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        out = tf.astype(np.float64)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            out[hit] *= self.idf[at[hit]]
        return out


def _icws(ids: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle the logarithm of its draw (the lowest is sampled) and the level t it would be sampled at."""
    r = -np.log(v.unit(ids, 11) * v.unit(ids, 12))
    c = -np.log(v.unit(ids, 13) * v.unit(ids, 14))
    beta = v.unit(ids, 15)
    t = np.floor(log_w / r + beta)
    return np.log(c) - r * (t - beta + 1), t


def _elements(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries split into elements: the j-th of a shingle is the same in all texts and weighs 1, the last one the rest."""
    times = np.maximum(np.ceil(weight), 1).astype(np.int64)
    if len(times) == times.sum():
        return doc, ids, weight
    entry = np.repeat(np.arange(len(ids)), times)
    j = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    later = np.where(j > 0, v.mix(j.astype(v.U64), 23), v.U64(0))
    return doc[entry], ids[entry] ^ later, np.minimum(weight[entry] - j, 1)


def signatures(n: int, doc: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``n`` rows of ``BINS`` samples (0 in rows without shingles) of weighted sets given as sorted (doc, id) entries."""
    out = np.zeros(n * BINS, v.U64)
    if not len(doc):
        return out.reshape(n, BINS)
    doc, ids, weight = _elements(doc, ids, weight)
    log_w = np.log(weight)
    value, t = _icws(ids, log_w)
    key = doc * BINS + (((v.mix(ids, 16) >> v.U64(32)) * v.U64(BINS)) >> v.U64(32)).astype(np.int64)
    best = np.full(n * BINS, np.inf)
    np.minimum.at(best, key, value)
    won = value == best[key]
    sample = lambda i, t: v.mix(i ^ v.mix(t.astype(np.int64).view(v.U64), 17), 18)
    out[key[won]] = sample(ids[won], t[won])
    counts = v.per_doc(doc, n)
    first = np.cumsum(counts) - counts
    empty = np.flatnonzero(np.isinf(best) & np.repeat(counts > 0, BINS))
    # All elements of the text, for each of its empty bins; some texts at a time to bound the arrays.
    for part in np.array_split(empty, 1 + int(counts[empty // BINS].sum() >> 18)):
        if not len(part):
            continue
        d, size = part // BINS, counts[part // BINS]
        at = np.cumsum(size) - size
        which = np.arange(size.sum()) - np.repeat(at - first[d], size)
        drawn = v.mix(ids[which] ^ v.mix(np.repeat(part % BINS, size).astype(v.U64), 19), 20)
        value, t = _icws(drawn, log_w[which])
        won = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, at), size))
        out[np.repeat(part, size)[won]] = sample(ids[which[won]], t[won])
    return out.reshape(n, BINS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each row and band, different ones for different bands."""
    odd = v.mix(np.arange(ROWS, dtype=v.U64), 21) | v.U64(1)
    return v.mix((samples.reshape(-1, BANDS, ROWS) * odd).sum(axis=2, dtype=v.U64) + v.mix(np.arange(BANDS, dtype=v.U64), 22))


def _signed(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, key, bands (empty for texts without words) and sketch (16 bits of each sample) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                doc, ids, tf = _shingle_counts(t)
                samples = signatures(len(t), doc, ids, shared.value.of(ids, tf))
                band = band_keys(samples).view(np.int64)
                has = v.per_doc(doc, len(t)) > 0
                at = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                sketch = [x.tobytes() for x in (samples >> v.U64(48)).astype("<u2")]
                fixed = [batch.column(c).slice(t.first, len(t)) for c in ("doc_id", "key")]
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(band[has].ravel()))
                yield pa.RecordBatch.from_arrays([*fixed, bands, pa.array(sketch, pa.binary())], names=["doc_id", "key", "bands", "sketch"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, bands array<long>, sketch binary")


def _vectors(texts: DataFrame) -> DataFrame:
    """(id, shingles): 32 bits of each shingle of each text, sorted, repeated as often as it occurs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                doc, ids, tf = _shingle_counts(t)
                packed = np.repeat((ids >> v.U64(8)).astype("<u4"), tf)
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=tf, minlength=len(t)).astype(np.int64))])
                rows = [packed[at[i]:at[i + 1]].tobytes() for i in range(len(t))]
                yield pa.record_batch([batch.column("id").slice(t.first, len(t)), pa.array(rows, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(pack, "id long, shingles binary")


def weighted_jaccard(a: bytes, b: bytes, weights: Weights) -> float:
    """Sum of the lower over sum of the higher weights of two packed shingle sets."""
    (x, x_tf), (y, y_tf) = (np.unique(np.frombuffer(s, "<u4"), return_counts=True) for s in (a, b))
    xw, yw = weights.of(x, x_tf), weights.of(y, y_tf)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = np.minimum(xw[i], yw[j]).sum()
    return float(low / (xw.sum() + yw.sum() - low))


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches agree often enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= AGREE)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    of = lambda c, s: texts.select(F.col("id").alias(c), F.col("sketch").alias(s))
    return pairs.join(of("b", "y").hint("merge"), "b").join(of("a", "x").hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def _similar(pairs: DataFrame, vectors: DataFrame, weights: Weights, share: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity is at least ``share``."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights.short())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            same = [weighted_jaccard(x[i].as_buffer(), y[i].as_buffer(), shared.value) >= share for i in range(len(batch))]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    of = lambda c, s: vectors.select(F.col("id").alias(c), F.col("shingles").alias(s))
    return pairs.join(of("b", "y").hint("merge"), "b").join(of("a", "x").hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def _packed(shingles: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a packed set and their numbers."""
    return np.unique(np.frombuffer(shingles.as_buffer(), "<u4"), return_counts=True)


def _rarity(vectors: DataFrame) -> np.ndarray:
    """How many texts have a shingle, counted in ``CELLS`` cells by the shingle's upper bits."""
    shift = 33 - CELLS.bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            each = [_packed(x)[0] for x in batch.column("shingles")]
            if each:
                cells += np.bincount(np.concatenate(each) >> shift, minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(some), pa.array(cells[some])], ["cell", "c"])

    sums = vectors.select("shingles").mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[sums.column("cell").to_numpy()] = sums.column("c").to_numpy()
    return np.minimum(out, 0xFFFFFFFF).astype("<u4")


def _prefixes(vectors: DataFrame, weights: Weights, share: float) -> DataFrame:
    """(bucket, id, rest, whole): the first shingles of each text, rare ones first, as far as the weight from there on is ``share`` of the whole.

    If two texts are similar, the weight of either from their first common shingle on is at least what they share,
    which is at least ``share`` of the weight of each.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((weights.short(), _rarity(vectors)))
    shift = 33 - CELLS.bit_length()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, rarity = shared.value
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
                ids, tf = _packed(x)
                order = np.argsort((rarity[ids >> shift].astype(v.U64) << v.U64(32)) | ids)
                w = short.of(ids, tf)[order]
                rest = np.cumsum(w[::-1])[::-1]
                n = np.searchsorted(-rest, -share * rest[0] * (1 - 1e-9), "right")
                held.append((ids[order[:n]].astype(np.int64), np.full(n, i), rest[:n], np.full(n, rest[0])))
            if held:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["bucket", "id", "rest", "whole"])

    return vectors.select("id", "shingles").mapInArrow(first, "bucket long, id long, rest double, whole double")


def _buckets(texts: DataFrame) -> DataFrame:
    """(bucket, id, n): the buckets of texts by a band and their sizes, without those of one text."""
    each = texts.where(F.size("bands") > 0).select("id", F.explode("bands").alias("bucket"))
    several = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(several.hint("merge"), "bucket")


class _Classes:
    """The links found so far, their classes and the pairs compared."""

    def __init__(self, texts: DataFrame, weights: Weights, share: float, space: Workspace):
        self.texts, self.weights, self.share, self.space = texts, weights, share, space
        self.vectors = self.labels = self.tested = self.links = None
        self.step, self.labelled = 0, True

    def placed(self, members: DataFrame) -> DataFrame:
        """The members of buckets of several classes, with their label."""
        self.label()
        if self.labels is None:
            return members.withColumn("label", F.col("id"))
        all_of = members.join(self.labels.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = self.space.stage(all_of.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), f"mixed-{self.step}")
        return all_of.join(mixed.hint("merge"), "bucket")

    def label(self) -> None:
        """Classes by all links found so far."""
        if not self.labelled:
            self.labels, self.labelled = components(self.links, self.space, f"classes-{self.step}"), True

    def compare(self, met: DataFrame) -> None:
        """Compare the pairs (a, id) of ``met`` that were not compared before."""
        pairs = met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = self.space.stage(pairs, f"pairs-{self.step}")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        found = self.space.stage(_similar(_likely(pairs, self.texts), self.vectors, self.weights, self.share), f"links-{self.step}")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.step, self.labelled = self.step + 1, False

    def with_pivots(self, members: DataFrame, possible: Column | None = None) -> None:
        """Compare the members of each bucket of several classes with the one of the highest rank, if that is of another class."""
        placed = self.space.stage(self.placed(members), f"placed-{self.step}")
        fixed = [c for c in ("id", "label", "rest", "whole") if c in placed.columns]
        hub = placed.groupBy("bucket").agg(F.max_by(F.struct(*fixed), "rank").alias("hub"))
        hubs = self.space.stage(hub.select("bucket", *[F.col(f"hub.{c}").alias("a" if c == "id" else f"a_{c}") for c in fixed]), f"hubs-{self.step}")
        other = F.col("label") != F.col("a_label")
        self.compare(placed.join(hubs.hint("merge"), "bucket").where(other if possible is None else other & possible))

    def settle(self, members: DataFrame) -> None:
        """Compare until every two members of a bucket are of one class, were compared, or share too little of their prefixes."""
        self.with_pivots(members)
        left = self.space.stage(self.placed(members).groupBy("id").agg(F.first("rank").alias("rank")), "left")
        if left.isEmpty():
            return
        vectors = self.space.stage(self.vectors.join(left.hint("merge"), "id"), "left-vectors")
        entries = self.space.stage(_prefixes(vectors, self.weights, self.share).join(left.hint("merge"), "id"), "prefixes")
        # What two texts share is at least this part of both weights added up, and lies behind their first common shingle.
        enough = F.least("rest", "a_rest") >= (F.col("whole") + F.col("a_whole")) * (self.share / (1 + self.share) * (1 - 1e-9))
        self.with_pivots(entries, enough)
        rest = self.space.stage(self.placed(entries), "rest")
        other = rest.select("bucket", *[F.col(c).alias("a" if c == "id" else f"a_{c}") for c in ("id", "label", "rest", "whole")])
        self.compare(rest.join(other.hint("merge"), "bucket").where((F.col("label") < F.col("a_label")) & enough))


def near_duplicate_classes(docs: DataFrame, space: Workspace, share: float = 0.8) -> DataFrame:
    """doc_id, key (of the text), class_id (lowest doc_id of its class) and class_texts (different texts in it), a row per row.

    Classes are the connected components of the similarity at ``share``. Equal texts are of one class, also empty and
    null ones (taken as empty) and texts without words; a text of one to four words has one shingle of all of them.
    Rows that repeat a doc_id keep a row each. A null doc_id counts as the highest; a class of null ids has a null
    class_id. An empty table gives an empty one; other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    weights = Weights(*frequent_shingles(docs))
    rows = space.stage(_signed(docs, weights), "rows")
    texts = rows.groupBy("key").agg(*[f(c).alias(c) for f, c in ((F.min, "doc_id"), (F.first, "bands"), (F.first, "sketch"))])
    texts = space.stage(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    members = space.stage(_buckets(texts), "buckets")
    # Pivots come in the order of the sizes of their buckets; the lower bits settle ties.
    rank = (F.sum("n") * 65536 + F.pmod(F.xxhash64("id"), F.lit(65536))).alias("rank")
    ranks = space.stage(members.groupBy("id").agg(rank), "ranks")
    found = _Classes(texts, weights, share, space)
    candidates = space.stage(ranks.select("id").join(texts, "id").select("id", F.col("key").alias("of"), F.col("doc_id").alias("first_id")), "candidates")
    here = (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    whole = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").join(candidates.hint("merge"), here).select("id", "text")
    # Rows that repeat an id and text are one text.
    found.vectors = space.stage(_vectors(whole.dropDuplicates(["id"])), "vectors")
    found.settle(space.stage(members.join(ranks.hint("merge"), "id"), "members"))
    found.label()
    joined = texts.select("key", "doc_id", "id").withColumn("label", F.col("id"))
    if found.labels is not None:
        joined = joined.drop("label").join(found.labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    classes = joined.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_texts"))
    by_text = space.stage(joined.select("key", "label").join(classes, "label").drop("label"), "classes")
    return rows.select("doc_id", "key").join(by_text, "key").select("doc_id", "key", "class_id", "class_texts")


def deduplicated(docs: DataFrame, space: Workspace, share: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: one with the class's lowest doc_id. All columns stay."""
    classes = near_duplicate_classes(docs, space, share)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(
        F.min("key").alias("__key"), F.count("*").alias("__rows"))
    first = space.stage(first.withColumnRenamed("class_id", "__id"), "first")
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")
    kept = row.join(first, here)
    once = kept.where("__rows = 1").select("__row.*")
    # Only rows that repeat an id meet here.
    repeated = kept.where("__rows > 1").groupBy("__id", "__key").agg(F.min("__row").alias("__row")).select("__row.*")
    return once.unionByName(repeated)
