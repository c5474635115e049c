"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs are sparse: one for each distinct word (hashed, weighing 1 / sqrt of their number), one for the bin of each
statistic of the text's structure, and one for the bin of the character count. Every input has a weight and a vector;
inputs i and j interact by the product of their vectors. The sum over all pairs is taken in linear time as half of
(square of the sum - sum of the squares), per dimension.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents; their inputs, not their texts, are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as v
from .quality_rules import text_statistics
from .sampling import fold, labelled_sample
from .workspace import Workspace

SAMPLE = 6000
WORD_BITS = 16
RANK = 8
#: Edges of the bins of the shares among the statistics.
SHARE_EDGES = np.array([1e-9, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
_BINS = 64
_DIGIT, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True


def _statistics(t: v.Texts, n_chars: np.ndarray) -> list[np.ndarray]:
    """The bin of each statistic of each text."""
    s = text_statistics(t)
    sums = {k: np.concatenate([[0], np.cumsum(f[t.buf])]) for k, f in (("digit", _DIGIT), ("stop", _STOP))}
    of = {k: x[t.offsets[1:]] - x[t.offsets[:-1]] for k, x in sums.items()}
    share = lambda a, b: np.searchsorted(SHARE_EDGES, a / np.maximum(b, 1), "right")
    log = lambda x: np.minimum(np.log2(np.maximum(x, 0) + 1).astype(np.int64), _BINS - 2)
    return [
        share(s["n_symbols"], s["word_chars"]), share(s["n_dup_lines"], s["n_lines"]), share(s["n_repeat_words"], s["n_words"]),
        share(s["n_capitals"], s["n_letters"]), share(of["digit"], s["word_chars"]), share(of["stop"], s["n_words"]),
        np.minimum(s["word_chars"] // np.maximum(s["n_words"], 1), _BINS - 2), log(s["n_words"]), log(s["n_words"] / np.maximum(s["n_lines"], 1)),
        np.where(n_chars < 0, _BINS - 1, log(n_chars)),
    ]


N_STATISTICS = 10
N_INPUTS = (1 << WORD_BITS) + N_STATISTICS * _BINS


def inputs(t: v.Texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, input and value of every input of a piece, sorted by text; each text has all its statistics."""
    w = v.words(t)
    doc, h, _ = v.doc_counts(w.doc, v.span_hashes(t.buf, w.start, w.end))
    value = 1 / np.sqrt(v.per_doc(doc, len(t)))[doc]
    bins = np.stack(_statistics(t, n_chars), 1) + np.arange(N_STATISTICS) * _BINS + (1 << WORD_BITS)
    docs = np.concatenate([doc, np.repeat(np.arange(len(t)), N_STATISTICS)])
    order = np.argsort(docs, kind="stable")
    at = np.concatenate([(v.mix(h, 61) & v.U64((1 << WORD_BITS) - 1)).astype(np.int64), bins.ravel()])
    return docs[order], at[order], np.concatenate([value, np.ones(bins.size)])[order]


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 0) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        return cls(0.0, np.zeros(N_INPUTS, np.float32), rng.normal(0, 0.05, (N_INPUTS, RANK)).astype(np.float32))

    def margins(self, doc: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each text, and per text the sum of its weighted vectors. Every text has an input."""
        first = np.flatnonzero(np.append([True], doc[1:] != doc[:-1]))
        x = self.vectors[at] * value[:, None]
        total = np.add.reduceat(x, first, axis=0)
        pairs = 0.5 * (total ** 2 - np.add.reduceat(x ** 2, first, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[at] * value, first) + pairs, total

    def fit(self, doc: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> None:
        """Log loss, steps scaled by the root of the summed squared gradients."""
        rng = np.random.default_rng(seed)
        first = np.searchsorted(doc, np.arange(len(y) + 1))
        sum_w, sum_v, sum_b = np.full(len(self.weight), 1e-2), np.full(self.vectors.shape, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                rows = order[a:a + batch]
                which = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
                d = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
                i, x = at[which], value[which].astype(np.float32)
                margin, total = self.margins(d, i, x)
                slope = ((1 / (1 + np.exp(-margin)) - y[rows]) / len(rows)).astype(np.float32)
                used, back = np.unique(i, return_inverse=True)
                g_w = np.bincount(back, slope[d] * x) + decay * self.weight[used]
                each = (slope[d] * x)[:, None] * (total[d] - self.vectors[i] * x[:, None])
                g_v = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], 1) + decay * self.vectors[used]
                g_b = slope.sum()
                sum_w[used] += g_w ** 2
                sum_v[used] += g_v ** 2
                sum_b += g_b ** 2
                self.weight[used] -= rate * g_w / np.sqrt(sum_w[used])
                self.vectors[used] -= rate * g_v / np.sqrt(sum_v[used])
                self.bias -= rate * g_b / np.sqrt(sum_b)


def _gathered(sample: DataFrame) -> pa.Table:
    """y, inputs and values of the sample, one row a document."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                doc, at, value = inputs(t, _chars(batch, t))
                ends = pa.array(np.concatenate([[0], np.cumsum(v.per_doc(doc, len(t)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(t.first, len(t)), batch.column("y").slice(t.first, len(t)), *lists], names=["doc_id", "y", "at", "value"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    return sample.mapInArrow(featurise, f"doc_id {kind}, y int, at array<int>, value array<float>").orderBy("doc_id").toArrow()


def _chars(batch: pa.RecordBatch, t: v.Texts) -> np.ndarray:
    return batch.column("n_chars").slice(t.first, len(t)).fill_null(-1).to_numpy()


def train(sample: DataFrame) -> FactorisationMachine:
    """Fit on ``sample`` (doc_id, text, n_chars, y). Without rows the model knows nothing: its scores lie about 0.5."""
    rows = _gathered(sample)
    model = FactorisationMachine.fresh()
    y = rows.column("y").to_numpy()
    if len(y):
        at, value = (rows.column(c).combine_chunks() for c in ("at", "value"))
        doc = np.repeat(np.arange(len(y)), at.value_lengths().to_numpy())
        share = (y.sum() + 1) / (len(y) + 2)
        model.bias = float(np.log(share / (1 - share)))
        model.fit(doc, at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), y)
    return model


def scored(docs: DataFrame, labels: DataFrame, space: Workspace, label: str = "quality", folds: int = 4, out: int = 2,
           cutoff: float = 0.7, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted of each row of ``docs``.

    Learns from labelled rows whose fold is not ``out``. Null texts are empty texts and are scored by their statistics;
    a null n_chars, or a table without it, is a value of its own. Rows that repeat a doc_id are scored each. A null
    doc_id is not held out. Without labels scores lie about 0.5 and tell nothing. Other columns are not looked at.
    """
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    texts = docs.select("doc_id", "text", chars.alias("n_chars"))
    model = train(labelled_sample(texts, labels, label, fold(F.col("doc_id"), folds) != out, most, ["text", "n_chars"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                margin, _ = shared.value.margins(*inputs(t, _chars(batch, t)))
                yield pa.record_batch([batch.column("doc_id").slice(t.first, len(t)), pa.array(1 / (1 + np.exp(-margin.astype(np.float64))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(score, f"doc_id {kind}, score double").select("doc_id", _held(folds, out), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def _held(folds: int, out: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out")
