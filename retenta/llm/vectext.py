"""Words, shingles and hashes of a batch of texts as numpy arrays, without a Python loop over words.

A batch is one buffer of UTF-8 bytes with the offsets of its texts, as Arrow holds a string column. Words are runs of
bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a longer UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A batch is cut into pieces of about so many bytes of text, to bound the arrays made from it. A longer text is a piece.
PIECE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit integers over all bits (the finaliser of splitmix64)."""
    x = x + U64((seed * _BASE + _BASE) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(256, dtype=U64), 1)
BYTE_VALUES_LOWER = BYTE_VALUES[LOWER]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next batch."""
    known = _POWERS[base]
    if len(known) < n:
        steps = np.full(max(n, len(known) + len(known) // 4), base, U64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return known[:n]


def unit(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) drawn from hashes."""
    return ((mix(h, seed) >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


@dataclass
class Texts:
    """Texts of one piece: their rows in the batch are first .. first + len(offsets) - 2."""

    buf: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i]:self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a piece, in order: where each starts and ends in the buffer, and its text's place in the piece."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column, null as empty, in pieces of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    yield from cut(Texts(data, offsets, 0), limit)


def cut(t: Texts, limit: int) -> Iterator[Texts]:
    """The texts of a piece in smaller ones of about ``limit`` bytes."""
    i = 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(t.offsets, t.offsets[i] + limit, "right")) - 1)
        yield Texts(t.buf[t.offsets[i]:t.offsets[j]], t.offsets[i:j + 1] - t.offsets[i], t.first + i)
        i = j


def words(t: Texts, outside: np.ndarray = SPACE) -> Words:
    """Runs of bytes for which ``outside`` is false."""
    inside = ~outside[t.buf]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    cut = np.zeros(len(inside) + 1, bool)
    cut[t.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(last) + 1
    return Words(start, end, np.repeat(np.arange(len(t)), np.diff(np.searchsorted(start, t.offsets))))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the bytes of each span [start, end), A-Z as a-z if ``lower``; equal bytes, equal hash."""
    n = len(buf)
    sums = np.zeros(n + 1, U64)
    np.cumsum((BYTE_VALUES_LOWER if lower else BYTE_VALUES)[buf] * powers(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start]
    return mix(h + (end - start).astype(U64))


def changes(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return np.flatnonzero(first)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and the place of each one given among them.

    One sort of the top bits of the hashes, each with its place in the bits below; all bits are sorted where the top ones don't tell them apart.
    """
    bits = len(h).bit_length()
    x = h >> U64(bits) << U64(bits) | np.arange(len(h), dtype=U64)
    x.sort()
    at = (x & U64((1 << bits) - 1)).astype(np.int64)
    x >>= U64(bits)
    ordered = h[at]
    first = changes(ordered)
    if len(changes(x)) < len(first):
        return np.unique(h, return_inverse=True)
    back = np.empty(len(h), np.int64)
    back[at] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    return ordered[first], back


def times(group: np.ndarray) -> np.ndarray:
    """How often each of these numbers is there."""
    bits = len(group).bit_length()
    if bits + int(group.max(initial=0)).bit_length() > 64:
        return (lambda u, i, n: n[i])(*np.unique(group, return_inverse=True, return_counts=True))
    x = group.astype(U64) << U64(bits) | np.arange(len(group), dtype=U64)
    x.sort()
    n = np.diff(np.append(changes(x >> U64(bits)), len(x)))
    out = np.empty(len(group), np.int64)
    out[(x & U64((1 << bits) - 1)).astype(np.int64)] = np.repeat(n, n)
    return out


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """How many entries each of ``n`` texts has."""
    return np.bincount(doc, minlength=n).astype(np.int64)


def shingles(w: Words, h: np.ndarray, n_docs: int, k: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each run of ``k`` words in a text. If ``short``, a text of 1 to k-1 words has one of all."""
    n = len(h)
    odd = mix(np.arange(k, dtype=U64), 2) | U64(1)
    if n >= k:
        at = np.flatnonzero(w.doc[:n - k + 1] == w.doc[k - 1:])
        s = np.zeros(len(at), U64)
        for j in range(k):
            s += h[at + j] * odd[j]
    else:
        at, s = np.zeros(0, np.int64), np.zeros(0, U64)
    doc = w.doc[at]
    if short and n:
        counts = per_doc(w.doc, n_docs)
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            first = np.searchsorted(w.doc, few)
            extra = np.array([(h[a:a + c] * odd[:c]).sum(dtype=U64) + U64(c) for a, c in zip(first, counts[few], strict=True)], U64)
            s, doc, at = np.concatenate([s, extra]), np.concatenate([doc, few]), np.concatenate([at, first])
            order = np.argsort(at, kind="stable")
            s, doc, at = s[order], doc[order], at[order]
    return mix(s), doc, at


def doc_counts(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs with their number, sorted by text, then hash; hashes keep their top 40 bits."""
    key = (doc.astype(U64) << U64(40)) | (h >> U64(24))
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    key = key[at]
    return (key >> U64(40)).astype(np.int64), key & U64((1 << 40) - 1), np.diff(np.append(at, len(first)))
