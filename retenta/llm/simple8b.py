"""Simple-8b: integers packed in 64-bit words, with whole-array numpy coding.

The top four bits of a word select how many values of how many bits fill the other 60. Values are coded in blocks of
``BLOCK``; each block starts at a word of its own, whose index is kept, so blocks can be decoded in any order or all at
once. The last word of a block may be partly filled. Selector 0 is an escape: the next word is a value of over 60 bits.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
U64 = np.uint64
#: Selector: (values, bits of each). Selector 0 is the escape.
SELECTORS = {15: (60, 1), 14: (30, 2), 13: (20, 3), 12: (15, 4), 11: (12, 5), 10: (10, 6), 9: (8, 7), 8: (7, 8), 7: (6, 10),
             6: (5, 12), 5: (4, 15), 4: (3, 20), 3: (2, 30), 2: (1, 60)}
COUNTS = np.ones(16, np.int64)
COUNTS[list(SELECTORS)] = [n for n, _ in SELECTORS.values()]


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 61 for those over 60."""
    bits = np.frexp(values.astype(np.float64))[1]
    return np.where(values >> U64(60), 61, np.maximum(np.minimum(bits, 60), 1)).astype(np.uint8)


def _widest(bits: np.ndarray, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """At each place the most bits among the next ``n`` values of its block."""
    if n not in known:
        half = n // 2
        a, b = _widest(bits, half, known), _widest(bits, n - half, known)
        out = a.copy()
        out[:, :-half] = np.maximum(a[:, :-half], b[:, half:])
        known[n] = out
    return known[n]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the index of each block's first word."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    padded = np.zeros(blocks * BLOCK + 60, U64)
    padded[:n] = values
    bits = _bits(padded[:blocks * BLOCK]).reshape(blocks, BLOCK)
    bits.ravel()[n:] = 0
    chosen = np.zeros((blocks, BLOCK), np.uint8)
    known = {1: bits}
    for s, (count, width) in sorted(SELECTORS.items()):  # the last that fits has the most values
        chosen[_widest(bits, count, known) <= width] = s
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - BLOCK * (blocks - 1)
    row, pos = np.arange(blocks), np.zeros(blocks, np.int64)
    at: list[np.ndarray] = []
    while len(row):  # all blocks step from word to word together
        at.append(row * BLOCK + pos)
        pos = pos + COUNTS[chosen[row, pos]]
        more = pos < lengths[row]
        row, pos = row[more], pos[more]
    start = np.sort(np.concatenate(at))
    sel = chosen.ravel()[start]
    place = np.arange(len(start)) + np.cumsum(sel == 0) - (sel == 0)
    words = np.zeros(len(start) + int((sel == 0).sum()), U64)
    end_of_block = (start // BLOCK + 1) * BLOCK
    for s, (count, width) in SELECTORS.items():
        mine = np.flatnonzero(sel == s)
        word = np.full(len(mine), s << 60, U64)
        for j in range(count):
            i = start[mine] + j
            word |= np.where(i < end_of_block[mine], padded[i], U64(0)) << U64(j * width)
        words[place[mine]] = word
    raw = np.flatnonzero(sel == 0)
    words[place[raw] + 1] = padded[start[raw]]
    return words, place[np.searchsorted(start, np.arange(blocks) * BLOCK)]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values coded in ``words``, all blocks at once."""
    out = np.zeros(len(offsets) * BLOCK, U64)
    sel = (words >> U64(60)).astype(np.int64)
    counts = COUNTS[sel]
    escapes, after = [], -1
    for i in np.flatnonzero(sel == 0):
        if i != after:  # else it is the value of an escape
            escapes.append(i)
            after = i + 1
    raw = np.zeros(len(words), bool)
    raw[np.array(escapes, np.int64) + 1] = True
    counts[raw] = 0
    before = np.cumsum(counts) - counts
    sizes = np.diff(np.append(offsets, len(words)))
    block = np.repeat(np.arange(len(offsets)), sizes)
    start = before - before[offsets][block] + block * BLOCK
    for s, (count, width) in SELECTORS.items():
        mine = np.flatnonzero((sel == s) & ~raw)
        for j in range(count):
            i = start[mine] + j
            inside = i < (block[mine] + 1) * BLOCK
            out[i[inside]] = (words[mine[inside]] >> U64(j * width)) & U64((1 << width) - 1)
    e = np.array(escapes, np.int64)
    out[start[e]] = words[e + 1]
    return out[:n]
