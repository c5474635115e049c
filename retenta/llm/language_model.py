"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

A count c is quantised to level 1 + floor(log_1.5 c), and the n-gram is put into a Bloom filter once for each level up
to its own. A query probes level 1, 2, ... until one is missing; the last level found gives the count. The filter holds
unigrams and bigrams of the training texts. It is cut into segments by hash; a segment is built by one task from all
counts of its n-grams, with ``BITS`` bits an entry, so the error rate is the same for every corpus.

The filter is not sent anywhere, however large or small it is. The distinct n-grams of each block of texts, with their
counts in its training texts, go to the segments by one shuffle; a segment is built from them and answers them at once.
It starts at the level of an n-gram's count, as that and all below are in the filter by construction. Its answers, a byte
an n-gram, meet the block again, which is shuffled as one compressed Arrow stream.

The probability of a word w after v is lambda * c(vw) / c(v) + (1 - lambda) * (c(w) + 1) / (N + V + 1), with a lambda
for each level of c(v), fitted by expectation-maximisation on all training texts, whose own counts are taken off. The
maximisation needs only the level and the ratio of the two shares of each token, so one scan counts the tokens by level
and ratio (in steps of 1/256 of its binary logarithm), and all rounds run on those counts. Every text starts after an end token and closes with one.

Exact word counts, for the base score: those of words with at least one in ``FREQUENT`` of all tokens (at most that
many words) are broadcast. The others' hashes go to the segments with the n-grams of their block and are counted there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import vectext as v
from .workspace import Workspace

BITS = 12
LEVEL_BASE = 1.5
FREQUENT = 1_000_000
#: Tokens counted together before they are shuffled.
FLUSH = 1 << 20
#: Steps of the binary logarithm of a ratio that tokens are counted by for the weights lambda.
RATIO_STEPS = 256
#: Bytes of text of a block, whose distinct n-grams are asked for together.
BLOCK_BYTES = 4 << 20
END = v.mix(np.array([0xE0D], v.U64), 41)[0]
_KEY_BITS = 48
_LEVEL_STEP = 0xD1342543DE82EF95
#: Bytes of text, and n-grams, whose arrays fit into a core's cache.
_NEAR_BYTES, _NEAR_KEYS = 1 << 17, 1 << 14


@dataclass
class Tokens:
    """Hashes of the tokens of a piece (words, then an end token, of each text), the hash before each, and their text."""

    h: np.ndarray
    prev: np.ndarray
    doc: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return v.mix(self.prev * v.U64(0x9E3779B97F4A7C15) + self.h, 42)


def tokens(t: v.Texts) -> Tokens:
    found, counts = [np.zeros(0, v.U64)], [np.zeros(0, np.int64)]
    for some in v.cut(t, _NEAR_BYTES):
        w = v.words(some)
        counts.append(v.per_doc(w.doc, len(some)) + 1)
        h = np.full(len(w.doc) + len(some), END, v.U64)
        inside = np.ones(len(h), bool)
        inside[np.cumsum(counts[-1]) - 1] = False
        h[inside] = v.span_hashes(some.buf, w.start, w.end)
        found.append(h)
    h = np.concatenate(found)
    prev = np.empty_like(h)
    prev[1:], prev[:1] = h[:-1], END
    return Tokens(h, prev, np.repeat(np.arange(len(t)), np.concatenate(counts)))


def levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(c) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """The count that stands for each level, 0 for none."""
    q = np.arange(1, 120)
    low, high = np.ceil(LEVEL_BASE ** (q - 1) - 1e-9), np.ceil(LEVEL_BASE ** q - 1e-9) - 1
    return np.concatenate([[0], np.sqrt(low * np.maximum(low, high))])


class CountFilter:
    """The segments of the filter as one array of 64-bit words."""

    def __init__(self, segments: int, first: np.ndarray, size: np.ndarray, words: np.ndarray):
        self.segments, self.first, self.size, self.words = segments, first, size, words

    @staticmethod
    def _places(x: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Two words of a segment and three bits in each."""
        for half in (v.mix(x, 43), v.mix(x, 44)):
            at = ((half >> v.U64(32)) * size.astype(v.U64)) >> v.U64(32)
            bits = (v.U64(1) << (half & v.U64(63))) | (v.U64(1) << ((half >> v.U64(6)) & v.U64(63))) | (v.U64(1) << ((half >> v.U64(12)) & v.U64(63)))
            yield at.astype(np.int64), bits

    @classmethod
    def segment(cls, keys: np.ndarray, counts: np.ndarray, most_words: int | None = None) -> np.ndarray:
        """The words of a segment that holds these n-grams, at most so many if that is given."""
        q = levels(counts)
        words = np.zeros(min(most_words or 1 << 60, -(-int(q.sum()) * BITS // 64)), v.U64)
        for i in range(0, len(keys), _NEAR_KEYS):
            near, most = keys[i:i + _NEAR_KEYS], q[i:i + _NEAR_KEYS]
            for level in range(1, int(most.max()) + 1):
                x = near[most >= level] + v.U64(level * _LEVEL_STEP & 0xFFFFFFFFFFFFFFFF)
                for at, bits in cls._places(x, np.full(len(x), len(words))):
                    np.bitwise_or.at(words, at, bits)
        return words

    def level(self, h: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The level of each n-gram: repeated probes, one level higher as long as the filter has it.

        ``known``: a level of each that the filter is known to have, with all below it.
        """
        out = np.zeros(len(h), np.int64) if known is None else known.copy()
        for i in range(0, len(h), _NEAR_KEYS):
            self._raise(h[i:i + _NEAR_KEYS], out[i:i + _NEAR_KEYS])
        return out

    def _raise(self, h: np.ndarray, out: np.ndarray) -> None:
        seg = _segment_of(h, self.segments)
        key, first, size = h & v.U64((1 << _KEY_BITS) - 1), self.first[seg], self.size[seg]
        at = np.flatnonzero(size > 0)
        while len(at):
            x = key[at] + (out[at] + 1).astype(v.U64) * v.U64(_LEVEL_STEP)
            found = np.ones(len(at), bool)
            for place, bits in self._places(x, size[at]):
                found &= self.words[first[at] + place] & bits == bits
            at = at[found]
            out[at] += 1


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _counted(h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(h), return_counts=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): hash and number of each token of ``texts``, end tokens included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> pa.RecordBatch:
            h, c = _counted(held)
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for t in v.pieces(batch.column(0)):
                held.append(tokens(t).h)
                n += len(held[-1])
                if n >= FLUSH:
                    yield report()
                    held, n = [], 0
        if n:
            yield report()

    return texts.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> v.U64(_KEY_BITS)).astype(np.int64) & (segments - 1)


def _codes(h: np.ndarray, segments: int) -> np.ndarray:
    """Segment and key of each n-gram as one number."""
    return h & v.U64((segments << _KEY_BITS) - 1)


def _entries(t: Tokens, learnt: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the distinct n-grams of a block, sorted, and how often each is in texts to learn from."""
    x = _codes(np.concatenate([t.h, t.pairs]), segments) << v.U64(1)
    x |= np.tile(~learnt, 2).astype(v.U64)
    x.sort()
    first = v.changes(x)
    x, n = x[first], np.diff(np.append(first, len(x)))
    n[x & v.U64(1) == 1] = 0
    x >>= v.U64(1)
    first = v.changes(x)
    return x[first], np.add.reduceat(n, first) if len(first) else n


#: Counts from here on follow the other columns of packed entries.
_LARGE = 255


def _packed(code: np.ndarray, n: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The entries of each segment column by column: 32, 8 and 8 bits of the key, a byte of the count, large counts."""
    columns = code.astype("<u4"), (code >> v.U64(32)).astype("u1"), (code >> v.U64(40)).astype("u1"), np.minimum(n, _LARGE).astype("u1")
    large, more = np.flatnonzero(n >= _LARGE), n[n >= _LARGE].astype("<i8")
    more_at = np.searchsorted(large, at)
    return [b"".join([*(x[a:b].tobytes() for x in columns), more[c:d].tobytes()]) for a, b, c, d in zip(at[:-1], at[1:], more_at[:-1], more_at[1:], strict=True)]


def _unpacked(entries: list[pa.Buffer], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of rows of ``n`` packed entries, one row after the other."""
    column = lambda kind, at: np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(entries, n, strict=True)])
    key = column("<u4", 0).astype(v.U64) | column("u1", 4).astype(v.U64) << v.U64(32) | column("u1", 5).astype(v.U64) << v.U64(40)
    count = column("u1", 6).astype(np.int64)
    count[count == _LARGE] = np.concatenate([np.frombuffer(x, "<i8", offset=7 * k) for x, k in zip(entries, n, strict=True)])
    return key, count


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers that the rows of a binary column hold."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def _binaries(data: np.ndarray, n: np.ndarray) -> pa.Array:
    """A column of ``n`` bytes of ``data`` a row."""
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


@dataclass
class Judged:
    """Of each token of a block: the exact count of its word, level of the word before, share after that word, share of all words."""

    count: np.ndarray
    level: np.ndarray
    after: np.ndarray
    alone: np.ndarray


@dataclass
class Model:
    segments: int
    total: int
    distinct: int
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def exact(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are frequent, and their exact counts."""
        if not len(self.frequent):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return self.frequent[at] == h, self.frequent_counts[at]

    def judged(self, t: Tokens, answers: np.ndarray, counts: np.ndarray, less: bool = False) -> Judged:
        """``answers``: the levels of the block's n-grams, as ``_entries``; ``counts`` of its ``_rare`` words. ``less`` the text's own counts."""
        stands = level_counts()
        words, back = v.distinct(t.h)
        pairs, pair_back = v.distinct(t.pairs)
        # The code is moved to the top bits, which keeps its order.
        place = v.distinct(_codes(np.concatenate([words, pairs]), self.segments) * v.U64((1 << 64 - _KEY_BITS) // self.segments))[1]
        found = answers[place].astype(np.int64)
        known, exact = self.exact(words)
        word_level = found[:len(words)]
        end = np.searchsorted(words, END)
        before = np.empty_like(back)
        before[1:], before[:1] = back[:-1], end
        exact[_rare(words, known, self.segments)] = counts
        count = np.where(known, exact, stands[word_level])
        word, context, pair = count[back], count[before], stands[found[len(words):]][pair_back]
        if less:
            own_word, own_pair = v.times(t.doc * len(words) + back), v.times(t.doc * len(pairs) + pair_back)
            # A text has its end token before its first word, so the words before its tokens are its tokens.
            first, last = v.changes(t.doc), np.append(v.changes(t.doc)[1:], len(t.doc)) - 1
            own_context = np.empty_like(own_word)
            own_context[1:], own_context[first] = own_word[:-1], own_word[last]
            word, pair, context = np.maximum(word - own_word, 0), np.maximum(pair - own_pair, 0), np.maximum(context - own_context, 0)
        after = np.divide(np.minimum(pair, context), context, out=np.zeros(len(pair)), where=context > 0)
        return Judged(exact[back], word_level[before], after, (word + 1) / (self.total + self.distinct + 1))


def scores(j: Judged, weights: np.ndarray) -> np.ndarray:
    w = weights[j.level]
    return np.log10(w * j.after + (1 - w) * j.alone)


def _rare(words: np.ndarray, known: np.ndarray, segments: int) -> np.ndarray:
    """The places of the words that are not frequent, by segment."""
    rare = np.flatnonzero(~known)
    return rare[np.argsort(_segment_of(words[rare], segments), kind="stable")]


def answered(texts: DataFrame, model: Broadcast[Model], block_bytes: int) -> DataFrame:
    """Build the filter, and ask it for all n-grams: (block, seg, levels, counts).

    Levels are a byte for each of ``_entries`` of the block in the segment, counts a number for each of its words that are ``_rare``.
    """
    segments = model.value.segments

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t, row in _numbered(batches, block_bytes):
            found = tokens(t)
            learnt = _learnt(batch.column("held_out").slice(t.first, len(t)))[found.doc]
            code, n = _entries(found, learnt, segments)
            at = np.append(np.searchsorted(code, np.arange(segments, dtype=v.U64) << v.U64(_KEY_BITS)), len(code))
            some = np.flatnonzero(np.diff(at))
            entries = _packed(code, n, np.append(at[some], len(code)))
            words, back = v.distinct(found.h)
            rare = _rare(words, model.value.exact(words)[0], segments)
            own = np.bincount(back, weights=learnt, minlength=len(words))[rare].astype("<u4")
            of = np.bincount(_segment_of(words[rare], segments), minlength=segments)[some]
            yield pa.record_batch([pa.array(np.full(len(some), row[0])), pa.array(some), pa.array(np.diff(at)[some]), pa.array(entries, pa.binary()),
                                   _binaries(words[rare].astype("<u8"), of * 8), _binaries(own, of * 4)], ["block", "seg", "n", "entries", "words", "own"])

    def answer(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        asked, count = _unpacked([x.as_buffer() for x in rows.column("entries")], n)
        key, back = np.unique(asked, return_inverse=True)
        count = np.bincount(back, weights=count)
        learnt = np.flatnonzero(count)
        known = np.zeros(len(key), np.int64)
        known[learnt] = levels(count[learnt])
        words = CountFilter.segment(key[learnt], count[learnt]) if len(learnt) else np.zeros(0, v.U64)
        found = CountFilter(1, np.zeros(1, np.int64), np.array([len(words)]), words).level(key, known)
        word, place = np.unique(_joined(rows.column("words"), "<u8"), return_inverse=True)
        counts = np.bincount(place, weights=_joined(rows.column("own"), "<u4"), minlength=len(word)).astype("<u4")[place]
        of = pc.binary_length(rows.column("own")).to_numpy()
        return pa.table({"block": rows.column("block"), "seg": rows.column("seg"), "levels": _binaries(found.astype(np.uint8)[back], n), "counts": _binaries(counts, of)})

    asked = texts.mapInArrow(ask, "block long, seg long, n long, entries binary, words binary, own binary")
    return asked.groupBy("seg").applyInArrow(answer, "block long, seg long, levels binary, counts binary")


def ratio_cells(level: np.ndarray, after: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Level, and step of the ratio of both shares (0: none), of each token as one number."""
    step = np.zeros(len(level), np.int64)
    some = after > 0
    step[some] = np.rint(np.log2(after[some] / alone[some]) * RATIO_STEPS).astype(np.int64) + (1 << 20)
    return level << 32 | step


def fitted_weights(cell: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The weight of the word before, for each level of its count, from the number of training tokens in each cell."""
    weights = np.full(128, 0.1)
    if not len(cell):
        return weights
    level, step = cell >> 32, cell & 0xFFFFFFFF
    ratio = np.where(step > 0, 2.0 ** ((step - (1 << 20)) / RATIO_STEPS), 0.0)
    tokens_at = np.bincount(level, n, len(weights))
    for _ in range(rounds):
        w = weights[level]
        share = w * ratio / (w * ratio + (1 - w))
        weights = (np.bincount(level, share * n, len(weights)) + 0.01) / (tokens_at + 1)
    return weights


def _cells(j: Judged, learnt: np.ndarray) -> pa.RecordBatch:
    cell, n = np.unique(ratio_cells(j.level[learnt], j.after[learnt], j.alone[learnt]), return_counts=True)
    return pa.record_batch([pa.array(cell), pa.array(n)], ["cell", "n"])


def train(texts: DataFrame, space: Workspace, block_bytes: int = BLOCK_BYTES) -> tuple[Broadcast[Model], DataFrame]:
    """The model of the rows of ``texts`` (text; null: empty) that are not held out, and what the segments answer."""
    learnt = texts.where(~F.col("held_out"))
    vocabulary = space.stage(word_counts(learnt), "words")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    often = vocabulary.where((F.col("c") * FREQUENT >= sums["n"]) & (F.col("c") > 1)).toArrow()
    h, c = often.column("h").to_numpy().view(v.U64), often.column("c").to_numpy().astype(np.float64)
    order = np.argsort(h)
    size = F.octet_length("text").cast("long")
    sizes = texts.agg(F.sum(size).alias("all"), F.sum(F.when(~F.col("held_out"), size)).alias("learnt")).first()
    # About a million tokens a segment, or four million with those that are asked for only.
    most = max(1, sums["n"]) / 1e6 * max(1, (sizes["all"] or 0) / max(1, sizes["learnt"] or 0) / 4)
    segments = 1 << int(np.clip(np.ceil(np.log2(most)), 4, 15))
    model = texts.sparkSession.sparkContext.broadcast(Model(segments, sums["n"], sums["v"], h[order], c[order]))
    return model, space.stage(answered(texts, model, block_bytes), "answers")


def _row_id(i: np.ndarray) -> np.ndarray:
    return (np.int64(TaskContext.get().partitionId()) << np.int64(36)) + i


def _numbered(batches: Iterator[pa.RecordBatch], limit: int = v.PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, v.Texts, np.ndarray]]:
    """The pieces of the batches of a task, with the numbers of their rows."""
    n = 0
    for batch in batches:
        for t in v.pieces(batch.column("text"), limit):
            yield batch, t, _row_id(n + np.arange(len(t)))
            n += len(t)


def _learnt(held: pa.Array) -> np.ndarray:
    return ~held.fill_null(True).to_numpy(zero_copy_only=False)


def scored(docs: DataFrame, training: Column, space: Workspace, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``, beside doc_id and ``held_out``.

    ``training`` marks the rows to learn from; the others are held out. Null texts are empty and consist of an end
    token. Without training rows no token is known, and the base probability of a token is 1. Rows that repeat a
    doc_id are scored each; other columns are not looked at. A row is known by its place, so ``docs`` is written first
    unless it is a table of files.
    """
    texts = space.stored(docs.select("doc_id", "text", (~training).alias("held_out")), "documents")
    shared, answers = train(texts, space, block_bytes)
    total = shared.value.total
    log_total = float(np.log10(total + shared.value.distinct + 1))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t, row in _numbered(batches, block_bytes):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch.slice(t.first, len(t)))
            yield pa.record_batch([pa.array(row[:1]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])

    def each_block(weights: np.ndarray | None, schema: str) -> DataFrame:
        """The scores of the rows; without ``weights`` what they are fitted on."""

        def meet(block: pa.Table, found: pa.Table) -> pa.Table:
            texts = pa.ipc.open_stream(block.column("texts")[0].as_buffer()).read_all().combine_chunks()
            (t,) = v.pieces(texts.column("text"), 1 << 62)
            found = found.sort_by("seg")
            levels, counts = _joined(found.column("levels"), "u1"), _joined(found.column("counts"), "<u4")
            doc_id, held = (texts.column(c).combine_chunks() for c in ("doc_id", "held_out"))
            found = tokens(t)
            j = shared.value.judged(found, levels, counts, less=weights is None)
            if weights is None:
                return pa.Table.from_batches([_cells(j, _learnt(held)[found.doc])])
            each = lambda x: np.bincount(found.doc, weights=x, minlength=len(t))
            return pa.Table.from_arrays(
                [doc_id, held, pa.array(v.per_doc(found.doc, len(t))), pa.array(each(j.count > 0).astype(np.int64)), pa.array(np.full(len(t), total)),
                 pa.array(each(np.log10(j.count + 1) - log_total)), pa.array(each(scores(j, weights)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        placed = texts.mapInArrow(place, "block long, texts binary")
        return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)

    cells = each_block(None, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = fitted_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy())
    return each_block(weights, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
