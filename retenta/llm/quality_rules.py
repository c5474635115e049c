"""Quality rules with risk-controlled thresholds.

Four shares of a text (symbols, repeated lines, words in repeated runs, capitals) are compared with cutoffs. A cutoff
is used in a stratum only if labelled documents prove, by an exact binomial test, that it rejects at most a stated
share of the good documents there. The tests of a rule go from the most lenient cutoff down and stop at the first that
fails, so they need no correction among themselves; the error probability is divided by the number of rules and
strata (Bonferroni), and the permitted share by the number of rules. Of the proven cutoffs that one is taken that
rejects the most bad documents for the least good ones. A stratum with too few labels has no cutoff and rejects nothing
beyond the base rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as v
from .workspace import Workspace

WINDOW = 5
RULES = ("symbols", "dup_lines", "repeats", "capitals")
CUTOFFS = tuple(round(0.95 - 0.05 * i, 2) for i in range(19)) + (0.02, 0.01)
#: The share of good documents that all rules together may reject in a stratum, and the probability of exceeding it.
RISK, ERROR = 0.05, 0.05
#: How many good documents a cutoff may reject for each further bad one that it catches is the inverse of this.
GOOD_COST = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = _LETTER[65:91] = _LETTER[97:123] = True


def _repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: whether its text has the hash again, and whether its text had it before. Entries are in text order."""
    key = h + v.mix(doc.astype(v.U64), 31)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:]] = same
    before[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def text_statistics(t: v.Texts) -> dict[str, np.ndarray]:
    """Counts of each text of a piece."""
    n, buf = len(t), t.buf
    w = v.words(t)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[t.offsets[1:]] - sums[t.offsets[:-1]]

    inside = ~v.SPACE[buf]
    h = v.span_hashes(buf, w.start, w.end, lower=False)
    run, doc, at = v.shingles(w, h, n, WINDOW, short=False)
    again, _ = _repeated(doc, run)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + WINDOW, -1)
    covered = np.cumsum(step)[:-1] > 0
    # Lines: from a text's start or the byte after a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(buf == 0x0A)
    begin = np.union1d(t.offsets[:-1], feeds + 1)
    begin = begin[begin < len(buf)] if len(buf) else begin[:0]
    stop = np.minimum(np.append(begin[1:], len(buf)), len(buf))
    stop = np.where((stop > begin) & (buf[stop - 1] == 0x0A) if len(begin) else False, stop - 1, stop)
    in_words = np.concatenate([[0], np.cumsum(inside)])
    full = in_words[stop] > in_words[begin]
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(t.offsets, begin, "right") - 1
    _, earlier = _repeated(line_doc, v.span_hashes(buf, begin, stop, lower=False))
    return {
        "n_words": v.per_doc(w.doc, n), "word_chars": total(inside & ((buf & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[buf]),
        "n_dup_lines": v.per_doc(line_doc[earlier], n), "n_repeat_words": v.per_doc(w.doc[covered], n),
        "n_lines": v.per_doc(line_doc, n), "n_capitals": total(_CAPITAL[buf]), "n_letters": total(_LETTER[buf]),
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")


def document_statistics(docs: DataFrame, stratum: str = "lang", rows: bool = False) -> DataFrame:
    """doc_id, stratum and the counts of each text (null: empty); with ``rows`` the whole row beside them, as a struct."""
    columns = [F.col(f"`{c}`") for c in (docs.columns if rows else ("doc_id", stratum, "text"))]
    whole = docs.select(F.struct(*columns).alias("row"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            for t in v.pieces(row.field("text")):
                found = text_statistics(t)
                part = row.slice(t.first, len(t))
                fixed = [part] if rows else [part.field("doc_id")]
                arrays = [*fixed, part.field(stratum), *(pa.array(found[c].astype(np.int64)) for c in STATISTICS)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row" if rows else "doc_id", "stratum", *STATISTICS])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    first = f"row {whole.schema['row'].dataType.simpleString()}" if rows else f"doc_id {types['doc_id']}"
    return whole.mapInArrow(count, f"{first}, stratum {types[stratum]}, " + ", ".join(f"{c} long" for c in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _shares() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "n_letters")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p; a rate above p is disproved at that level by k rejections in n."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def pick_cutoff(good: list[int], bad: list[int], n_good: int, risk: float, error: float) -> float | None:
    """The cutoff to use, from the numbers of good and bad documents above each of ``CUTOFFS``; None: none is proven."""
    best, value = None, 0
    for cutoff, g, b in zip(CUTOFFS, good, bad, strict=True):
        if g > n_good * risk or binomial_tail(g, n_good, risk) > error:
            break
        if b - GOOD_COST * g > value:
            best, value = cutoff, b - GOOD_COST * g
    return best


def calibrated(stats: DataFrame, labels: DataFrame, space: Workspace, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """of (the stratum) and a cutoff (or null) per rule, from all labelled documents that pass the base rule.

    ``labels`` has doc_id and quality; null qualities are left out, and of several labels of one document the best counts.
    """
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("good"))
    judged = stats.where(~base_failed()).join(quality, F.col("doc_id") == F.col("labelled"))
    above = {f"{r}_{i}": F.sum((x > c).cast("long")) for r, x in _shares().items() for i, c in enumerate(CUTOFFS)}
    counts = judged.groupBy("stratum", (F.col("good") == 1).alias("good")).agg(F.count("*").alias("n"), *[x.alias(c) for c, x in above.items()])
    counts = space.stage(counts, "counts")
    strata = max(1, counts.select("stratum").distinct().count())

    def pick(rows: pa.Table) -> pa.Table:
        by = {bool(r["good"]): r for r in rows.to_pylist()}
        of = lambda side, r: [int(by[side][f"{r}_{i}"]) if side in by else 0 for i in range(len(CUTOFFS))]
        n = int(by[True]["n"]) if True in by else 0
        found = {r: pick_cutoff(of(True, r), of(False, r), n, risk / len(RULES), error / (len(RULES) * strata)) for r in RULES}
        stratum = rows.column("stratum").combine_chunks().slice(0, 1)
        return pa.table([stratum, *(pa.array([found[r]], pa.float64()) for r in RULES)], names=["of", *(f"cut_{r}" for r in RULES)])

    kind = stats.schema["stratum"].dataType.simpleString()
    return counts.groupBy("stratum").applyInArrow(pick, f"of {kind}, " + ", ".join(f"cut_{r} double" for r in RULES))


def _verdicts(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    rejected = F.lit(False)
    for r, share in _shares().items():
        rejected |= F.coalesce(share > F.col(f"cut_{r}"), F.lit(False))
    found = stats.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return found.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected})


def judged(docs: DataFrame, labels: DataFrame, space: Workspace, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of ``docs``.

    A null or empty text has no words and fails the base rule. A null stratum is one of its own. Rows that repeat a
    doc_id are judged each. Without labels, or with too few in a stratum, only the base rule rejects. An empty table
    gives an empty one; other columns are not looked at.
    """
    stats = space.stage(document_statistics(docs, stratum), "statistics")
    cutoffs = space.stage(calibrated(stats, labels, space), "cutoffs")
    return _verdicts(stats, cutoffs).select("doc_id", *STATISTICS, "base_failed", "kept")


def quality_filtered(docs: DataFrame, labels: DataFrame, space: Workspace, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept; all columns stay, whatever their names."""
    stats = space.stage(document_statistics(docs, stratum), "statistics")
    cutoffs = space.stage(calibrated(stats, labels, space), "cutoffs")
    return _verdicts(document_statistics(docs, stratum, rows=True), cutoffs).where("kept").select("row.*")
