"""Importance resampling: the n-gram table, and the whole operator against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from retenta.llm import ngram_table, resampling
from retenta.llm import vectext as v
from retenta.llm.workspace import Workspace

from .brute import LOWER

DOCS = "doc_id long, text string, weight double, rank string, score long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, targets, percent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in targets for f in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + buckets)) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in rows:
        n, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAZ09 .\t\n\x00é　ß{", max_size=60), min_size=1, max_size=5), st.integers(1, 40), st.integers(1, 3))
def test_interned_ngrams_are_those_of_plain_python(texts, limit, longest):
    got = []
    for t in v.pieces(pa.array(texts, pa.string()), limit):
        s = ngram_table.spans(t, longest)
        table = ngram_table.interned(s, 97)
        assert ngram_table.xxhash64(s).tolist() == [xxhash.xxh64_intdigest(s.bytes(i)) for i in range(len(s.start))]
        grams = [s.bytes(i).decode() for i in range(len(s.start))]
        assert [table.bucket[x] for x in table.slot] == [zlib.crc32(g.encode()) % 97 for g in grams]
        assert [table.count[x] for x in table.slot] == [Counter(grams)[g] for g in grams]
        assert len(set(grams)) == len(table.used) == len(set(table.slot.tolist()))
        for d in range(len(t)):
            got.append((int(s.n_words[d]), sorted(g for g, x in zip(grams, s.doc, strict=True) if x == d)))
    assert got == [(n, sorted(f)) for n, f in (features(t, longest) for t in texts)]


def test_equal_hashes_do_not_make_equal_ngrams(monkeypatch):
    monkeypatch.setattr(ngram_table, "xxhash64", lambda s: np.full(len(s.start), 5, np.uint64))
    words = [f"w{i}" * (1 + i % 9) for i in range(60)] * 2
    t = next(v.pieces(pa.array([" ".join(words)])))
    s = ngram_table.spans(t, 1)
    table = ngram_table.interned(s, 1000)
    assert len(table.used) == 60 and set(table.count[table.used].tolist()) == {2}
    assert [table.bucket[x] for x in table.slot] == [zlib.crc32(w.encode()) % 1000 for w in words]


def test_resampling_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [f"{a}{b}" for a in ("la", "Mé", "x", "word" * 12) for b in range(50)]
    prose = lambda n, m=200: rng.choice([" ", ", ", "\n"]).join(pool[rng.randrange(m)] for _ in range(n))
    rows = [(i, prose(rng.randrange(0, 60))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " .\n"), (903, prose(30_000)), (None, prose(40)), (None, None), rows[3], rows[3], (4, prose(25))]
    targets = [prose(30, 20) for _ in range(10)] + [None, ""]
    table = spark.createDataFrame([(i, t, 1.5, "x", 9) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(t, 3) for t in targets], "text string, doc_id long")
    run = lambda a, b, **k: resampling.resampled(a, b, Workspace(spark, "test"), **k)
    got = run(table, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, targets)
    got = run(table, bench, percent=100, least_words=1, seed=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, targets, 100, 1, 2)
    assert sorted(map(tuple, run(table, bench.limit(0)).collect()), key=repr) == brute(rows, [])
    assert run(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("share", [0.9])
def test_ranks_hold_where_most_rows_are_equal(spark, share):
    rows = [(None if i < 1000 * share else i, "word " * 25) for i in range(1000)]
    table = spark.createDataFrame([(i, t, 1.5, "x", 9) for i, t in rows], DOCS).repartition(7)
    bench = spark.createDataFrame([("word word",)], "text string")
    got = resampling.resampled(table, bench, Workspace(spark, "test")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, ["word word"])


def test_drawn_documents_keep_their_columns(spark):
    rows = [(i, "alpha beta " * 20 if i % 4 == 0 else f"gamma{i} delta " * 20) for i in range(200)]
    table = spark.createDataFrame([(i, t, 1.5, "x", 9) for i, t in rows], DOCS)
    bench = spark.createDataFrame([("alpha beta " * 20_000,)], "text string")
    got = resampling.drawn_documents(table, bench, Workspace(spark, "test"))
    assert got.columns == table.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == 50 and sum(i % 4 == 0 for i in ids) >= 40  # towards the target, though by noisy sums
