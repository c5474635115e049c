"""An open-addressed table of the n-grams of a batch of texts, in numpy arrays.

Words are runs of digits, a-z (A-Z are lowered first) and bytes from 0x80 on, an n-gram is some words joined by one
space. Each occurrence of an n-gram probes the table from its xxhash64 on; an entry is the same n-gram only if its bytes
are. So the table's slots number the distinct n-grams, and what is known of an n-gram is worked out once for all its
occurrences in the batch. All occurrences probe at the same time, one slot further each round.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import xxhash

from . import vectext as v

U64 = np.uint64
#: Bytes that are no part of a word.
OUTSIDE = np.ones(256, bool)
OUTSIDE[ord("0"):ord("9") + 1] = OUTSIDE[ord("A"):ord("Z") + 1] = OUTSIDE[ord("a"):ord("z") + 1] = OUTSIDE[0x80:] = False

# Fixed values of xxhash64.
P1, P2, P3, P4, P5 = (U64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer spans are hashed and compared one by one; such n-grams are rare.
LONG = 32


@dataclass
class Spans:
    """N-grams of a piece: where each starts in ``buf``, its length, its text, and its words' number less one as ``size``."""

    buf: np.ndarray
    eight: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray

    def bytes(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.start[i] + self.length[i]].tobytes()


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one little-endian number; bytes after the end are 0."""
    x = np.zeros(len(buf) + 8, U64)
    x[:len(buf)] = buf
    for shift in (1, 2, 4):
        x[:-shift] |= x[shift:] << U64(8 * shift)
    return x


def spans(t: v.Texts, longest: int) -> Spans:
    """All runs of 1 to ``longest`` words of each text of a piece; ``n_words``: words of each text."""
    w = v.words(t, OUTSIDE)
    length = w.end - w.start
    at = np.cumsum(length + 1) - (length + 1)
    total = int((length + 1).sum())
    buf = np.full(total, 0x20, np.uint8)
    inside = np.ones(total, bool)
    inside[at + length] = False
    from_place = np.arange(total) - np.repeat(at - w.start, length + 1)
    buf[inside] = v.LOWER[t.buf[from_place[inside]]]
    starts, lengths, docs = [], [], []
    for k in range(longest):
        first = np.flatnonzero(w.doc[:len(at) - k] == w.doc[k:]) if len(at) > k else np.zeros(0, np.int64)
        starts.append(at[first])
        lengths.append(at[first + k] + length[first + k] - at[first])
        docs.append(w.doc[first])
    return Spans(buf, eights(buf), np.concatenate(starts), np.concatenate(lengths), np.concatenate(docs), v.per_doc(w.doc, len(t)))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxhash64(s: Spans) -> np.ndarray:
    """xxhash64 with seed 0 of every span."""
    h = s.length.astype(U64) + P5
    for j in range(LONG // 8):  # whole groups of eight bytes
        on = np.flatnonzero((s.length >= 8 * (j + 1)) & (s.length < LONG))
        if len(on):
            k = _rotate(s.eight[s.start[on] + 8 * j] * P2, 31) * P1
            h[on] = _rotate(h[on] ^ k, 27) * P1 + P4
    rest = s.length & 7
    place = s.start + s.length - rest
    on = np.flatnonzero(rest >= 4)
    h[on] = _rotate(h[on] ^ ((s.eight[place[on]] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    place, rest = place + (rest & 4), rest & 3
    for j in range(3):
        on = np.flatnonzero(rest > j)
        h[on] = _rotate(h[on] ^ (s.buf[place[on] + j].astype(U64) * P5), 11) * P1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    h ^= h >> U64(32)
    for i in np.flatnonzero(s.length >= LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(s.bytes(i))
    return h


def equal_bytes(s: Spans, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a[i] and b[i], which are of one length, have the same bytes."""
    length = s.length[a]
    same = np.ones(len(a), bool)
    for j in range(LONG // 8):
        on = np.flatnonzero(same & (length > 8 * j) & (length < LONG))
        if not len(on):
            continue
        unlike = s.eight[s.start[a[on]] + 8 * j] ^ s.eight[s.start[b[on]] + 8 * j]
        spare = np.maximum(8 * (j + 1) - length[on], 0).astype(U64)
        same[on] = (unlike << (spare * U64(8))) == 0
    for i in np.flatnonzero(length >= LONG).tolist():
        same[i] = s.bytes(a[i]) == s.bytes(b[i])
    return same


@dataclass
class Table:
    """``slot``: of each occurrence; ``used``: the slots in use, ``bucket`` and ``count`` of each slot (0 if unused)."""

    slot: np.ndarray
    used: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def interned(s: Spans, buckets: int) -> Table:
    """The table of a piece's n-grams; a bucket is the bytes' crc32 modulo ``buckets``."""
    n = len(s.start)
    size = 1 << max(4, (2 * n - 1).bit_length())
    key = xxhash64(s)
    owner = np.full(size, -1, np.int64)
    slot = np.zeros(n, np.int64)
    pending = np.arange(n)
    probe = (key & U64(size - 1)).astype(np.int64)
    while len(pending):
        free = owner[probe] < 0
        owner[probe[free]] = pending[free]  # of several that want a slot one gets it
        held = owner[probe]
        same = (key[held] == key[pending]) & (s.length[held] == s.length[pending])
        other = np.flatnonzero(same & (held != pending))
        same[other] = equal_bytes(s, held[other], pending[other])
        slot[pending[same]] = probe[same]
        pending, probe = pending[~same], (probe[~same] + 1) & (size - 1)
    used = np.flatnonzero(owner >= 0)
    bucket = np.zeros(size, np.int64)
    raw, crc = s.buf.tobytes(), zlib.crc32
    first = s.start[owner[used]]
    last = first + s.length[owner[used]]
    bucket[used] = np.fromiter((crc(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.int64, len(used)) % buckets
    return Table(slot, used, bucket, np.bincount(slot, minlength=size))
