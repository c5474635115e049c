"""Toxicity: a learnt lexicon, misspellings by Levenshtein automata, and context windows.

The lexicon is learnt from labelled texts. A term is a whole word, or the stem of words, that stands in toxic texts
more often than chance explains, in several surroundings; few surroundings count as few texts, as copies of one toxic
text would make all its words look toxic. Its weight is what a hit adds to the log-odds, by the lower confidence bound.
Words within one edit of a strong term count as misspelt terms, unless they are words of clean texts. A hit is quoted
if quotation marks stand around it in its window or reporting words stand in it. The probability is a logistic function
of the weights of the four kinds of hits (exact or misspelt, quoted or not) and the text's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as v
from .lexicon import Lexicon
from .sampling import fold, labelled_sample
from .workspace import Workspace

#: Labelled texts to learn from at most.
SAMPLE = 20_000
#: A stem has this many letters at least and a term that many surroundings; more than so many are not told apart.
STEM, SURROUNDINGS, MANY = 4, 5, 16
#: Letters of a stem at most; a longer word counts whole and by the stems among its first letters.
LONGEST_STEM = 64
#: A term weighs at least so much; a stronger one may be misspelt; a longer one replaces its stem if it adds so much.
WEIGHT, STRONG, ADDS = 1.2, 3.0, 0.8
#: Standard errors of the confidence bound of a term's share of toxic texts.
CONFIDENCE = 3.0
#: A kind of hits in fewer texts than this has no weight of its own.
FEW = 20
#: Words before and after a hit that tell a quotation.
WINDOW = 6
#: Words that report what others say.
REPORTING = ("said", "says", "quote", "quoted", "called", "wrote", "sagte", "sagt", "zitat", "schrieb", "dit", "citation", "dijo", "dice", "cita")
#: Words whose verdict a worker keeps.
KNOWN_WORDS = 1 << 20
#: What the logistic weights are drawn to: bias, length, exact, misspelt, quoted exact, quoted misspelt hits.
PRIOR = np.array([-3.0, 0.0, 1.0, 0.8, 0.5, 0.3])

_INNER = np.ones(256, bool)
_INNER[:128] = False
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_QUOTES = (b'"', "“".encode(), "”".encode(), "„".encode(), "«".encode(), "»".encode())


@dataclass
class Cores:
    """Words of a piece without the signs around them, lower-case hashes, and whether a quotation mark touches the word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    quote: np.ndarray


def _quote_places(buf: np.ndarray) -> np.ndarray:
    out = buf == _QUOTES[0][0]
    wide = np.zeros(len(buf), bool)
    for q in _QUOTES[1:]:
        at = np.ones(max(0, len(buf) - len(q) + 1), bool)
        for i, b in enumerate(q):
            at &= buf[i:len(buf) - len(q) + 1 + i] == b
        wide[:len(at)] |= at
    return out | wide


def cores(t: v.Texts) -> Cores:
    w = v.words(t)
    n = len(t.buf)
    if not n:
        return Cores(w.start, w.end, w.doc, np.zeros(0, v.U64), np.zeros(0, bool))
    quote = _quote_places(t.buf)
    inner = _INNER[t.buf] & ~quote
    # The bytes of a wide quotation mark are no letters either.
    wide = quote & (t.buf >= 0x80)
    for i in (1, 2):
        inner[i:] &= ~(wide[:-i] & ((t.buf[:-i] >= 0xE0) if i == 2 else True))
    place = np.arange(n)
    to_right = np.minimum.accumulate(np.where(inner, place, n)[::-1])[::-1]
    to_left = np.maximum.accumulate(np.where(inner, place, -1))
    start, end = to_right[w.start], to_left[w.end - 1] + 1
    empty = (start >= w.end) | (end <= w.start)
    start, end = np.where(empty, w.start, start), np.where(empty, w.start, end)
    marks = np.concatenate([[0], np.cumsum(quote)])
    return Cores(start, end, w.doc, v.span_hashes(t.buf, start, end), marks[w.end] > marks[w.start])


def _surroundings(c: Cores) -> np.ndarray:
    """A hash of the words before and after each word."""
    n = len(c.h)
    same = c.doc[1:] == c.doc[:-1]
    before, after = np.zeros(n, v.U64), np.zeros(n, v.U64)
    before[1:] = np.where(same, c.h[:-1], v.U64(0))
    after[:-1] = np.where(same, c.h[1:], v.U64(0))
    return v.mix(before * v.U64(3) + after, 71)


def word_evidence(sample: DataFrame) -> DataFrame:
    """word, toxic and clean (texts with it), and around (up to MANY hashes of surroundings in toxic texts), per batch piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                c = cores(t)
                if not len(c.h):
                    continue
                toxic = batch.column("y").slice(t.first, len(t)).to_numpy() == 1
                words, first, back = np.unique(c.h, return_index=True, return_inverse=True)
                pairs = np.unique(np.stack([back, c.doc]), axis=1)
                n_toxic = np.bincount(pairs[0], weights=toxic[pairs[1]], minlength=len(words)).astype(np.int64)
                n_all = np.bincount(pairs[0], minlength=len(words))
                hit = np.flatnonzero(toxic[c.doc])
                seen = np.unique(np.stack([back[hit].astype(v.U64), _surroundings(c)[hit]]), axis=1)
                at = np.searchsorted(seen[0], np.arange(len(words) + 1).astype(v.U64))
                around = [seen[1][a:min(b, a + MANY)].view(np.int64).tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                text = [t.buf[a:b].tobytes().decode().lower() for a, b in zip(c.start[first].tolist(), c.end[first].tolist(), strict=True)]
                yield pa.record_batch([pa.array(text, pa.string()), pa.array(n_toxic), pa.array(n_all - n_toxic), pa.array(around, pa.list_(pa.int64()))], ["word", "toxic", "clean", "around"])

    return sample.select("text", "y").mapInArrow(count, "word string, toxic long, clean long, around array<long>")


def term_weight(toxic: int, clean: int, base: float) -> float:
    """Log-odds of the lower bound (Wilson) of the share of toxic texts, over those of all texts."""
    n, z = toxic + clean, CONFIDENCE
    p = toxic / n
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    low = min(max(low, 1e-6), 1 - 1e-6)
    return math.log(low / (1 - low)) - math.log(base / (1 - base))


def learn_terms(sample: DataFrame, space: Workspace) -> list[tuple[str, bool, float]]:
    """The terms of a labelled sample (text, y): word or stem, whether it is a stem, and its weight; longer ones first."""
    merged = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, MANY)
    per_word = word_evidence(sample).where("length(word) > 1").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), merged("around").alias("around"))
    per_word = space.stage(per_word, "evidence")
    length = F.length("word")
    stems = F.when(length >= STEM, F.transform(F.sequence(F.lit(STEM), F.greatest(F.least(length, F.lit(LONGEST_STEM)), F.lit(STEM))), lambda i: F.substring(F.col("word"), F.lit(1), i)))
    whole = F.concat(F.col("word"), F.lit("\n"))  # no word has a line feed
    nodes = per_word.select(F.explode(F.concat(F.coalesce(stems, F.array().cast("array<string>")), F.array(whole))).alias("node"), "toxic", "clean", "around")
    found = nodes.groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), merged("around").alias("around"))
    size = F.size("around")
    found = found.select("node", F.when(size < MANY, F.least("toxic", size)).otherwise(F.col("toxic")).alias("toxic"), "clean", size.alias("size"))
    counts = sample.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    if not counts["toxic"] or counts["toxic"] == counts["n"]:
        return []
    base = counts["toxic"] / counts["n"]
    # A share of toxic texts below twice the usual one can't reach the least weight.
    rows = found.where((F.col("size") >= SURROUNDINGS) & (F.col("toxic") > 2 * base * (F.col("toxic") + F.col("clean")))).collect()
    weight = {r["node"]: w for r in rows if (w := term_weight(r["toxic"], r["clean"], base)) >= WEIGHT}
    terms: dict[str, float] = {}
    for node in sorted(weight, key=len):
        above = next((node[:i] for i in range(len(node) - 1, STEM - 1, -1) if node[:i] in terms), None)
        if above is None or weight[node] >= terms[above] + ADDS:
            terms[node] = weight[node]
        elif weight[node] == terms[above] and len(node) == len(above) + 1:
            terms[node] = terms.pop(above)  # the same texts: the stem goes on, or is a whole word
    return sorted(((x.rstrip("\n"), not x.endswith("\n"), w) for x, w in terms.items()), key=lambda x: (-len(x[0]), x))


@dataclass
class Matcher:
    """Finds the terms in texts. ``clean``: words that are no misspelling."""

    terms: list[tuple[str, bool, float]]
    clean: frozenset[str] = frozenset()
    known: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lexicon = Lexicon([(term, stem, w >= STRONG) for term, stem, w in self.terms])
        self.weights = np.array([w for _, _, w in self.terms])
        self.first, self.third = {term[:2] for term, _, _ in self.terms}, {term[2:4] for term, _, _ in self.terms if len(term) > 3}
        h = np.frombuffer("".join(REPORTING).encode(), np.uint8)
        at = np.cumsum([0, *map(len, REPORTING)])
        self.reporting = np.sort(v.span_hashes(h, at[:-1], at[1:]))

    def _possible(self, word: str) -> bool:
        """Whether a word may be within an edit of a term: one edit leaves the first pair of letters as it is, or the second one, which it may move by one."""
        return word[:2] in self.first or any(word[i:i + 2] in self.third for i in (1, 2, 3))

    def hits(self, t: v.Texts, c: Cores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that hit a term, the terms, and whether they are misspelt."""
        if not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        words, first, back = np.unique(c.h, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        verdict = np.zeros(len(words), np.int64)
        for i, h in enumerate(words.tolist()):
            found = self.known.get(h)
            if found is None:
                word = t.buf[c.start[first[i]]:c.end[first[i]]].tobytes().decode(errors="replace").lower()
                match = self.lexicon.match(word) if self._possible(word) else None
                found = self.known[h] = 0 if match is None or (match[1] and word in self.clean) else (match[0] + 1) * (-1 if match[1] else 1)
            verdict[i] = found
        verdict = verdict[back]
        hit = np.flatnonzero(verdict)
        return hit, np.abs(verdict[hit]) - 1, verdict[hit] < 0

    def quoted(self, c: Cores, at: np.ndarray) -> np.ndarray:
        """Whether quotation marks stand on both sides of a hit in its window, or a reporting word stands in it."""
        n = len(c.h)
        marks = np.concatenate([[0], np.cumsum(c.quote)])
        i = np.minimum(np.searchsorted(self.reporting, c.h), len(self.reporting) - 1)
        reports = np.concatenate([[0], np.cumsum(self.reporting[i] == c.h)])
        text_first, text_end = np.searchsorted(c.doc, c.doc[at]), np.searchsorted(c.doc, c.doc[at], "right")
        lo, hi = np.maximum(at - WINDOW, text_first), np.minimum(at + WINDOW + 1, np.minimum(text_end, n))
        around = (marks[at + 1] > marks[lo]) & (marks[hi] > marks[at])
        return around | (reports[hi] > reports[lo])

    def features(self, t: v.Texts) -> np.ndarray:
        """Per text the logarithm of its words, and the weights of its exact, misspelt, quoted exact and quoted misspelt hits."""
        c = cores(t)
        at, term, misspelt = self.hits(t, c)
        out = np.zeros((len(t), 5))
        out[:, 0] = np.log1p(v.per_doc(c.doc, len(t)))
        if len(at):
            np.add.at(out, (c.doc[at], 1 + misspelt + 2 * self.quoted(c, at)), self.weights[term])
        return out


@dataclass
class Toxicity:
    matcher: Matcher
    weights: np.ndarray

    def probabilities(self, t: v.Texts) -> np.ndarray:
        x = np.hstack([np.ones((len(t), 1)), self.matcher.features(t)])
        return sigmoid(x @ self.weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, spread: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton's method with halved steps, drawn to ``prior`` where the data say little."""
    x = np.hstack([np.ones((len(x), 1)), x])

    def loss(w: np.ndarray) -> float:
        m = x @ w
        return float((np.logaddexp(0, m) - y * m).sum() + ((w - prior) ** 2).sum() / (2 * spread ** 2))

    w = prior.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + (w - prior) / spread ** 2
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread ** 2, slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _clean_variants(sample: DataFrame, terms: list[tuple[str, bool, float]]) -> frozenset[str]:
    """Words of clean texts of the sample that would pass for a misspelt term."""
    matcher = Matcher(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                c = cores(t)
                at, _, misspelt = matcher.hits(t, c)
                words = {t.buf[c.start[i]:c.end[i]].tobytes().decode().lower() for i in at[misspelt]}
                yield pa.record_batch([pa.array(sorted(words), pa.string())], ["word"])

    clean = sample.where("y = 0").select("text").mapInArrow(find, "word string").distinct()
    return frozenset(r["word"] for r in clean.collect())


def train(sample: DataFrame, space: Workspace) -> Toxicity:
    """Learn from ``sample`` (doc_id, text, y): terms from all of it, words that are no misspelling from one half, weights from the other."""
    terms = learn_terms(sample, space)
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2 == 0
    matcher = Matcher(terms, _clean_variants(sample.where(half), terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                x = matcher.features(t)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(t.first, len(t)), *(pa.array(x[:, i]) for i in range(5))], names=["y", *"abcde"])

    rows = sample.where(~half).select("text", "y").mapInArrow(count, "y int, a double, b double, c double, d double, e double").toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in "abcde"], 1)
    weights = fit_weights(x, rows.column("y").to_numpy())
    # Kinds of hits that the sample hardly has weigh by their prior share of what exact hits do.
    for kind in range(3, 6):
        if (x[:, kind - 1] > 0).sum() < FEW:
            weights[kind] = weights[2] * PRIOR[kind] / PRIOR[2]
    # Both halves tell which words are no misspelling; the weights were fitted without that knowledge of their own half.
    return Toxicity(Matcher(terms, matcher.clean | _clean_variants(sample.where(~half), terms)), weights)


def scored(docs: DataFrame, labels: DataFrame, space: Workspace, label: str = "toxic", folds: int = 5, out: int = 0,
           cutoff: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted of each row of ``docs``.

    Learns from labelled rows whose fold is not ``out``. Null and empty texts have no hit. Rows that repeat a doc_id
    are scored each. A null doc_id is not held out. Without labels there is no lexicon and every score is low. Other
    columns are not looked at.
    """
    sample = labelled_sample(docs, labels, label, fold(F.col("doc_id"), folds) != out, most, ["text"])
    shared = docs.sparkSession.sparkContext.broadcast(train(space.stage(sample, "sample"), space))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in v.pieces(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(t.first, len(t)), pa.array(shared.value.probabilities(t))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held, "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
