"""Token ids of documents, and binary files of them in Simple-8b.

Documents are dealt by ranges of doc_id, sorted and encoded; each range is a shard. A shard's file is a Parquet file
of chunks: the ids of some whole documents, one after the other, as Simple-8b words with the block offsets, beside the
documents' ids and lengths and the number of ids before the chunk in its shard. Parquet makes the files readable from
any store, by any reader, chunk by chunk.

A word is encoded once a batch and kept for the next ones: this vocabulary drops white space and merges within words
only, so a text's ids are those of its words. Trailing ASCII punctuation is a piece of its own after a letter or digit.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import simple8b
from . import vectext as v

END = 2
#: Words whose ids a worker keeps; it starts anew beyond.
KNOWN_WORDS = 1 << 21
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCTUATION[ord("'")] = False  # starts contractions
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by a tokenizer that treats each word alone; words it has met are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first, self.count = np.zeros(0, v.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _units(self, t: v.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word without, then with only its trailing punctuation."""
        w = v.words(t)
        buf = t.buf
        at = np.where(_PUNCTUATION[buf], -1, np.arange(len(buf)))
        last = np.maximum(np.maximum.accumulate(at)[w.end - 1] if len(buf) else at[:0], w.start - 1)
        known = last >= w.start
        i = np.maximum(last, 0)
        latin = (buf[i] >= 0x80) & (buf[i - 1] == 0xC3) & (buf[i] != 0x97) & (buf[i] != 0xB7) & (last > w.start)
        cut = np.where(known & (_LETTER_OR_DIGIT[buf[i]] | latin), last + 1, w.end)
        start, end = np.stack([w.start, cut], 1).ravel(), np.stack([cut, w.end], 1).ravel()
        some = end > start
        return start[some], end[some], np.repeat(w.doc, 2)[some]

    def _learn(self, t: v.Texts, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Take in words, given in order of their hashes.

        Normalising and splitting leave a word of a-z as it is, so such a word goes straight to the tokenizer's model.
        """
        raw = t.buf.tobytes()
        others = np.concatenate([[0], np.cumsum(~_LETTER[t.buf])])
        plain = others[end] == others[start]
        each: list[list[int]] = [[]] * len(hashes)
        tokens = self.tokenizer.model.tokenize
        for i, a, b in zip(np.flatnonzero(plain).tolist(), start[plain].tolist(), end[plain].tolist(), strict=True):
            each[i] = [x.id for x in tokens(raw[a:b].decode().lower())]
        rest = np.flatnonzero(~plain)
        e = self.tokenizer.encode([raw[a:b].decode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)], is_pretokenized=True, add_special_tokens=False)
        of = rest[np.array(e.word_ids, np.int64)] if len(rest) else rest
        count = np.array([len(x) for x in each], np.int64) + np.bincount(of, minlength=len(hashes))
        first = np.cumsum(count) - count
        found = np.zeros(int(count.sum()), np.uint32)
        short = np.repeat(plain, count)
        found[short] = [x for ids in each for x in ids]
        found[~short] = e.ids
        self.ids, first = np.concatenate([self.ids, found]), first + len(self.ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.count = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def encode(self, t: v.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a piece, one after the other, and how many each text has."""
        start, end, doc = self._units(t)
        h, first, back = np.unique(v.span_hashes(t.buf, start, end), return_index=True, return_inverse=True)
        if len(self.hashes) + len(h) > KNOWN_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, h)  # both are sorted
        missing = np.append(self.hashes, v.U64(0))[at] != h
        missing |= at == len(self.hashes)
        if missing.any():
            self._learn(t, h[missing], start[first[missing]], end[first[missing]])
        at = np.searchsorted(self.hashes, h)[back]
        count = self.count[at]
        before = np.cumsum(count) - count
        ids = self.ids[np.arange(count.sum()) + np.repeat(self.first[at] - before, count)]
        lengths = np.bincount(doc, weights=count, minlength=len(t)).astype(np.int64)
        marked = self._marked(t)
        return self._with_marked(t, ids, lengths, marked) if len(marked) else (ids, lengths)

    def _marked(self, t: v.Texts) -> np.ndarray:
        """Texts that may hold the name of a special token, which the tokenizer finds inside words too."""
        found = np.flatnonzero((t.buf[:-1] == ord("<")) & (t.buf[1:] == ord("|")))
        return np.unique(np.searchsorted(t.offsets, found, "right") - 1)

    def _with_marked(self, t: v.Texts, ids: np.ndarray, lengths: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i in marked:
            parts[i] = np.array(self.tokenizer.encode(t.text(i).decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker, so that later tasks profit from what earlier ones met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END) -> None:
    """Encode each text (null: empty), append ``end_id``, and write the ids in ascending doc_id order, null first.

    Rows that repeat a doc_id each have their ids, in order of their texts' md5, and rows that repeat both in any order; they
    are dealt by these too, so no id is left to one task. An empty table gives files without chunks. Other columns are
    not looked at.
    """
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids_before, chunk = TaskContext.get().partitionId(), 0, 0
        coder = encoder(vocabulary)
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                ids, lengths = coder.encode(t)
                whole = np.full(len(ids) + len(t), end_id, np.uint64)
                ends = np.cumsum(lengths + 1) - 1
                inside = np.ones(len(whole), bool)
                inside[ends] = False
                whole[inside] = ids
                words, offsets = simple8b.encode(whole)
                yield pa.RecordBatch.from_pydict({
                    "shard": [shard], "chunk": [chunk], "ids_before": [ids_before], "n_ids": [len(whole)],
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), batch.column("doc_id").slice(t.first, len(t))),
                    "lengths": [(lengths + 1).tolist()], "words": [words.astype("<u8").tobytes()], "blocks": [offsets.astype("<u4").tobytes()],
                })
                chunk, ids_before = chunk + 1, ids_before + len(whole)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_md5", "row"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"text_md5": F.md5("text"), "row": F.monotonically_increasing_id()})
    in_order = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    in_order.mapInArrow(chunks, f"shard long, chunk long, ids_before long, n_ids long, doc_ids array<{id_type}>, lengths array<long>, words binary, blocks binary").write.mode("overwrite").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the files with ``first_id``: the number of ids in all chunks before."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("of"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    return files.join(starts, files["shard"] == starts["of"]).withColumn("first_id", F.col("shard_start") + F.col("ids_before"))


def _per_document(spark: SparkSession, path: str, schema: str, column: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """doc_id, start, n_tokens and a last column made from a chunk's ids and its documents' ends."""
    id_type = spark.read.parquet(path).schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, start long, n_tokens long, {schema}"
    names = [c.strip().split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, blocks = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("words", "<u8"), ("blocks", "<u4")))
                ids = simple8b.decode(words, blocks.astype(np.int64), batch.column("n_ids")[i].as_py())
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                start = batch.column("first_id")[i].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(start), pa.array(lengths), column(ids, ends)], names=names)

    return _placed(spark, path).select("first_id", "n_ids", "doc_ids", "lengths", "words", "blocks").mapInArrow(read, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document, decoded from the files."""
    return _per_document(spark, path, "ids array<int>", lambda ids, ends: pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), decoded from the files."""

    def crc(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.int64())

    return _per_document(spark, path, "ids_crc32 long", crc)
