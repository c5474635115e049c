"""The operators that work on bytes and words of texts, held against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retenta.llm import language_model, lexicon, near_dedup, quality_fm, quality_rules, repeats, simple8b, token_files, toxicity
from retenta.llm import vectext as v
from retenta.llm.workspace import Workspace

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
EDGES = [None, "", " ", "\n\t \x0b", "one", "a b c d", "é", "ÀÉ ß　x", "x" * 3000, "la " * 900, '"', "<|endoftext|> a", "a\x00b c"]


@pytest.fixture
def space(spark):
    return Workspace(spark, "test")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "k", 0.5) for i, t, lang in rows], COLUMNS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" + rng.choice(["", "", ",", "."]) for _ in range(n))


def with_edges(rng, texts):
    """Rows with the edge cases, a repeated row, a second row of an id and a null id."""
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, t, None) for i, t in enumerate(EDGES)]
    return rows + [rows[0], (1, prose(rng, 40), "de"), (None, prose(rng, 30), "en"), (None, texts[2], "en")]


# --- words and shingles ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abA \t\n\x0b　éß,", max_size=40)), min_size=1, max_size=6), st.integers(1, 30))
def test_words_of_any_texts(texts, limit):
    got, hashes = [], {}
    for t in v.pieces(pa.array(texts, pa.string()), limit):
        w = v.words(t)
        h = v.span_hashes(t.buf, w.start, w.end)
        for d in range(len(t)):
            got.append([t.buf[a:b].tobytes().decode() for a, b in zip(w.start[w.doc == d], w.end[w.doc == d], strict=True)])
        for a, b, x in zip(w.start, w.end, h.tolist(), strict=True):
            assert hashes.setdefault(t.buf[a:b].tobytes().decode().translate(brute.LOWER), x) == x
    assert got == [brute.words(t, lower=False) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


# --- near duplicates ---


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark, space):
    rng = random.Random(3)
    base = [prose(rng, n, 5000) for n in (8, 30, 60, 120, 250, 400, 90, 90)]
    passage = prose(rng, 60, 5000)
    texts = list(base)
    for _ in range(160):
        b = rng.choice(base)
        texts.append(edited(rng, b, rng.randrange(0, 1 + len(b.split()) // 25)))
    texts += [passage + " " + prose(rng, 60, 5000) for _ in range(60)]  # share a passage, are no near duplicates
    texts += [edited(rng, base[5], 3) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, "en") for i, t in enumerate(texts + EDGES)]
    table = docs(spark, rows)
    found = near_dedup.near_duplicate_classes(table, space).collect()
    want = brute.near_duplicate_classes([t for _, t, _ in rows])
    assert {r.doc_id: r.class_id for r in found} == {i: want[i] for i, _, _ in rows}
    kept = near_dedup.deduplicated(table.unionByName(table.limit(5)), space)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_crowded_buckets_are_settled_in_full(spark, space, monkeypatch):
    rng = random.Random(13)
    pairs = [prose(rng, 120, 5000) for _ in range(30)]
    rows = [(2 * i + j, edited(rng, t, j), "en") for i, t in enumerate(pairs) for j in range(2)]
    signed = near_dedup._signed
    # All texts share one band, and nothing else.
    one = F.array(F.lit(7).cast("long"), *[F.xxhash64("key", F.lit(i)) for i in range(near_dedup.BANDS - 1)])
    monkeypatch.setattr(near_dedup, "_signed", lambda docs, weights: signed(docs, weights).withColumn("bands", one))
    found = near_dedup.near_duplicate_classes(docs(spark, rows), space).collect()
    want = brute.near_duplicate_classes([t for _, t, _ in rows])
    assert len(set(want)) == 30 and {r.doc_id: r.class_id for r in found} == dict(enumerate(want))


def test_rows_that_repeat_id_and_text_are_one_text(spark, space):
    rng = random.Random(17)
    text = prose(rng, 120, 5000)
    texts = [text, edited(rng, text, 1)]
    found = near_dedup.near_duplicate_classes(docs(spark, [(None, t, "en") for t in texts for _ in range(40)]), space)
    assert {(r.class_id, r.class_texts) for r in found.collect()} == {(None, 2)} and found.count() == 80
    assert spark.read.parquet(f"{space.folder}/links-0").count() == 1


def test_near_duplicates_of_nothing(spark, space):
    assert near_dedup.near_duplicate_classes(docs(spark, []), space).count() == 0
    alone = near_dedup.near_duplicate_classes(docs(spark, [(1, None, None), (None, "a b", None)]), space).collect()
    assert sorted((r.doc_id is None, r.class_id) for r in alone) == [(False, 1), (True, None)]


def test_frequent_shingles_are_exact(spark):
    rng = random.Random(4)
    common = prose(rng, 12)
    texts = [(common + " " if i % 3 == 0 else "") + prose(rng, 30, 5000) for i in range(300)]
    total, ids, df = near_dedup.frequent_shingles(docs(spark, [(i, t, "en") for i, t in enumerate(texts)]))
    counts = Counter(s for t in texts for s in brute.shingle_counts(t))
    assert total == 300 and sorted(df) == sorted(c for c in counts.values() if c >= 3)


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 40, 400, dtype=np.uint64)
    a, b = np.sort(ids[:350]), np.sort(ids[50:])
    share = []
    for seed in range(40):
        moved = [np.sort(v.mix(x, seed) >> v.U64(24)) for x in (a, b)]
        sa, sb = (near_dedup.signatures(1, np.zeros(len(x), np.int64), x, 1 + (x % v.U64(3)).astype(float)) for x in moved)
        share.append((sa == sb).mean())
    assert np.mean(share) == pytest.approx(0.75, abs=0.03)


@pytest.mark.parametrize("shared, own, tf", [(100, 130, 20), (30, 60, 20), (10, 40, 50.5)])
def test_samples_of_repeated_passages(shared, own, tf):
    rng = np.random.default_rng(4)
    share, met = [], 0
    for _ in range(100):
        ids = rng.choice(1 << 40, shared + 2 * own, replace=False).astype(np.uint64)
        sides = []
        for mine in (ids[shared:shared + own], ids[shared + own:]):
            x = np.concatenate([ids[:shared], mine])
            order = np.argsort(x)
            sides.append(near_dedup.signatures(1, np.zeros(len(x), np.int64), x[order], np.repeat([float(tf), 1.0], [shared, own])[order]))
        share.append((sides[0] == sides[1]).mean())
        met += (near_dedup.band_keys(sides[0]) == near_dedup.band_keys(sides[1])).any() and (sides[0] == sides[1]).sum() >= near_dedup.AGREE
    assert np.mean(share) == pytest.approx(shared * tf / (shared * tf + 2 * own), abs=0.02)
    assert met >= 98


# --- repeated strings ---


def without_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        yield len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_repeats_equal_brute_force(spark, space):
    rng = random.Random(5)
    shared = [prose(rng, n, 5000) for n in (58, 75, 100, 130, 200, 300)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randrange(60), 5000)]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s) // 4), len(s) - rng.randrange(len(s) // 4)))
            parts += [s[a:b], prose(rng, rng.randrange(30), 5000)]
        texts.append("é".join(parts))
    texts += ["ab" * 600, "xyz" * 300 + "q" + "xyz" * 300, texts[0], texts[1] + "tail", "z" * 399, "z" * 400, "y" * 401, shared[5]]
    rows = [(i, t, None) for i, t in enumerate(texts + EDGES)] + [(None, shared[4], "en"), (3, texts[3], "en")]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs(spark, rows).repartition(3), space).collect())
    assert got == sorted(without_repeats([t for _, t, _ in rows]))
    assert repeats.without_repeats(docs(spark, []), space).count() == 0


def test_a_hot_gram_is_judged_from_counts(spark, space):
    rows = [(7, 1 if i % 2 else 2, i, 0) for i in range(1000)] + [(7, 100 + i, 5000 + i, 1) for i in range(3)] + [(8, 1, 1, 3), (9, 1, 4, 5), (9, 1, 4, 6)]
    found = {(r.row, r.k): r.verdict for r in repeats.anchor_verdicts(spark.createDataFrame(rows, "gram long, all long, row long, k int"), space).collect()}
    want = {(i, 0): repeats.STANDS if i < 2 else repeats.RESOLVED for i in range(1000)} | {(5000 + i, 1): repeats.UNRESOLVED for i in range(3)}
    assert found == want | {(4, 5): repeats.RESOLVED, (4, 6): repeats.RESOLVED}


# --- token files ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    a = np.array(values, np.uint64)
    words, offsets = simple8b.encode(a)
    assert len(offsets) == -(-len(a) // simple8b.BLOCK)
    assert (simple8b.decode(words, offsets, len(a)) == a).all()


def test_files_hold_the_ids_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = with_edges(rng, [prose(rng, rng.randrange(80)) + rng.choice(["", " it's WE'LL!! naïve, é… 3.14<b>", " a<|b"]) for _ in range(30)])
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs(spark, rows).repartition(3), path)
    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want, start = [], 0
    for i, t, _ in ordered:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, ids))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.ids) for r in token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    digests = {r.start: (r.n_tokens, r.ids_crc32) for r in token_files.token_digests(spark, path).collect()}
    assert digests == {s: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, s, x in want}
    token_files.write_token_files(docs(spark, []), path)
    assert token_files.token_digests(spark, path).count() == 0


def test_rows_without_ids_are_spread_over_the_files(spark, tmp_path):
    rows = [(None if i % 10 else i, f"text {i % 3}", "en") for i in range(4000)]
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_token_files(docs(spark, rows), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["sum(size(doc_ids))"] for r in spark.read.parquet(path).groupBy("shard").agg(F.sum(F.size("doc_ids"))).collect()]
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2000
    got = token_files.token_digests(spark, path)
    assert got.agg(F.count("*"), F.count("doc_id"), F.count_distinct("start")).collect()[0] == (4000, 400, 4000)


def test_plain_words_go_straight_to_the_model():
    from tokenizers import Tokenizer

    words = ["a", "Z", "xx" * 2000, "The", "don't", "ÀB", "naïve", "s", "ll", "INTERNATIONALISATION", "abc1", "it's", "é", "b.c"]
    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    texts = [" ".join(words), *words, " ".join(reversed(words))]
    coder = token_files.WordEncoder(token_files.default_vocabulary())
    for _ in range(2):  # learnt, and looked up
        for t in v.pieces(pa.array(texts), 20):
            ids, lengths = coder.encode(t)
            want = [tokenizer.encode(t.text(i).decode(), add_special_tokens=False).ids for i in range(len(t))]
            assert ids.tolist() == [x for w in want for x in w] and lengths.tolist() == [len(w) for w in want]


# --- quality rules ---


def test_counts_and_verdicts(spark, space):
    rng = random.Random(7)
    clean = [prose(rng, 60, 5000) for _ in range(60)]
    texts = clean + ["\n".join(["a b c d e f", "x y", "x y", "", " ", "a b c d e f", "x y "])] + ["p | q # " * 3 + prose(rng, 20)]
    rows = with_edges(rng, texts)
    got = quality_rules.judged(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int"), space).collect()
    want = Counter((i, *brute.quality_counts(t), brute.base_failed(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)
    assert quality_rules.judged(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int"), space).count() == 0


def test_cutoffs_are_proven_by_stratum(spark, space):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 6 == 0
        text = prose(rng, 40, 9000)
        rows.append((i, text.replace(" ", "### ") if bad else text, "en" if i % 10 else "de"))
        labels.append((i, 0 if bad else 1, 0))
    found = quality_rules.judged(docs(spark, rows), spark.createDataFrame([*labels, (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int"), space)
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] != (i % 6 == 0) for i in range(3000) if i % 10)
    assert all(kept[i] for i in range(0, 3000, 10))  # too few labels there to prove a cutoff
    assert quality_rules.quality_filtered(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), space).count() == sum(kept.values())


def test_binomial_bound_is_exact():
    for k, n, p in ((0, 50, 0.05), (3, 200, 0.01), (17, 400, 0.05)):
        q = Fraction(p)
        exact = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.pick_cutoff([0] * 21, [9] * 21, 100, 0.0125, 0.003) is None


# --- language model ---


def test_base_scores_and_counts(spark, space):
    rng = random.Random(9)
    rows = with_edges(rng, [prose(rng, rng.randrange(80)) for _ in range(80)])
    found = language_model.scored(docs(spark, rows).repartition(3), ~language_model.held_out(F.col("doc_id"), 7, 2), space).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*brute.words(t), None]) for i, t, _ in rows]
    counts = Counter(w for i, x in tokens if not out(i) for w in x)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, out(i), len(x), sum(w in counts for w in x), total,
                    round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in x), 6)) for i, x in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert language_model.scored(docs(spark, []), F.lit(True), space).count() == 0
    none = language_model.scored(docs(spark, rows[:3]), F.lit(False), space).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)


def test_a_predictable_order_scores_better_than_the_base(spark, space):
    rng = random.Random(10)
    following = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(3)] for i in range(300)}
    rows = []
    for i in range(300):
        w = ["w0"]
        while len(w) < 80:
            w.append(rng.choice(following[w[-1]]))
        rows.append((i, " ".join(w), "en"))
    found = [r for r in language_model.scored(docs(spark, rows), ~language_model.held_out(F.col("doc_id"), 7, 2), space).collect() if r.held_out]
    assert sum(r.score for r in found) > 0.6 * sum(r.base_score for r in found)


def test_weights_are_fitted_on_long_texts_too(spark, space):
    rng = random.Random(14)
    following = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(3)] for i in range(300)}
    rows = []
    for i in range(20):
        w = ["w0"]
        while len(w) < 6000:
            w.append(rng.choice(following[w[-1]]))
        rows.append((i, " ".join(w), "en"))
    assert min(len(t) for _, t, _ in rows) > 20000
    found = language_model.scored(docs(spark, rows), F.lit(True), space).collect()
    assert sum(r.score for r in found) > 0.4 * sum(r.base_score for r in found)


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark, space):
    rng = random.Random(15)
    rows = with_edges(rng, [prose(rng, rng.randrange(80)) for _ in range(120)])
    training = ~language_model.held_out(F.col("doc_id"), 7, 2)
    table = space.stage(docs(spark, rows).repartition(3), "same")
    near, far = (sorted(map(repr, language_model.scored(table, training, space, b).select("doc_id", "n_tokens", "n_known", F.round("score", 6)).collect())) for b in (1 << 20, 512))
    assert near == far


def test_no_filter_leaves_its_segment(spark, space, monkeypatch):
    """Not even a small one: then a large one costs no other path, on which each piece of text asked each segment on its own."""
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addFile", lambda *a, **b: sent.append(a))
    rng = random.Random(16)
    rows = [(i, prose(rng, 30), "en") for i in range(40)]
    found = language_model.scored(docs(spark, rows), ~language_model.held_out(F.col("doc_id"), 7, 2), space).collect()
    assert len(found) == 40 and not sent


def test_answers_are_those_of_the_whole_filter(spark, space):
    rng = random.Random(17)
    texts = [prose(rng, 1 + rng.randrange(60)) for _ in range(91)] + ["again " * 700, None, "again other"]  # at most one without a byte
    held = [None if i == 7 else i % 5 == 0 for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(texts, held, strict=True)), "text string, held_out boolean").repartition(3)
    segments, grams, learnt = 16, {}, Counter()
    for text, out in zip(texts, held, strict=True):
        t = language_model.tokens(next(v.pieces(pa.array([text], pa.string()))))
        grams[text] = {int(x) & (segments << 48) - 1 for x in (*t.h, *t.pairs)}
        learnt.update([int(x) & (segments << 48) - 1 for x in (*t.h, *t.pairs)] if out is False else [])
    want, codes = {}, sorted(learnt)
    for seg in range(segments):
        mine = [x for x in codes if x >> 48 == seg]
        keys, counts = np.array([x & (1 << 48) - 1 for x in mine], np.uint64), np.array([learnt[x] for x in mine])
        words = language_model.CountFilter.segment(keys, counts)
        f = language_model.CountFilter(1, np.array([0]), np.array([len(words)]), words)
        asked = sorted({x for g in grams.values() for x in g if x >> 48 == seg})
        want |= dict(zip(asked, f.level(np.array([x & (1 << 48) - 1 for x in asked], np.uint64)), strict=True))
    assert max(learnt.values()) > 600 and 0 in want.values()
    stored = space.stage(rows, "asked")
    model = spark.sparkContext.broadcast(language_model.Model(segments, 0, 0, np.zeros(0, np.uint64), np.zeros(0)))
    got = language_model.answered(stored, model, 1).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("seg", "levels"))).alias("of"))
    assert Counter(tuple(b for x in r.of for b in x.levels) for r in got.collect()) == Counter(tuple(want[g] for g in sorted(grams[t])) for t in texts)


@given(st.lists(st.integers(0, 5).map(lambda x: x * 0x2000000000000001 % (1 << 64)) | st.integers(0, 40), max_size=60))
def test_distinct_and_times_are_those_of_numpy(x):
    h = np.array(x, np.uint64)
    want, back, n = np.unique(h, return_inverse=True, return_counts=True)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(v.distinct(h), (want, back), strict=True))
    assert v.times(h.astype(np.int64) & 0xFFFF).tolist() == [Counter(y & 0xFFFF for y in x)[y & 0xFFFF] for y in x]
    assert v.times(h >> np.uint64(1)).tolist() == [Counter(y >> 1 for y in x)[y >> 1] for y in x]


def test_shares_take_off_what_each_text_counts_itself():
    texts = ["a b a b c", "b", "", "a a a", "c b a b"]
    t = language_model.tokens(next(v.pieces(pa.array(texts))))
    code, n = language_model._entries(t, np.ones(len(t.h), bool), 16)
    answers = language_model.levels(n).astype(np.uint8)
    words, counts = np.unique(t.h, return_counts=True)
    model = language_model.Model(16, len(t.h), len(words), words, counts.astype(float))
    got = model.judged(t, answers, np.zeros(0), less=True)
    split = [[*x.split(), ""] for x in texts]
    word = Counter(w for x in split for w in x)
    pair = Counter(p for x in split for p in zip(["", *x], x, strict=False))
    stands = language_model.level_counts()[language_model.levels(np.arange(1, 20))]
    after, alone = [], []
    for x in split:
        own, own_pair = Counter(x), Counter(zip(["", *x], x, strict=False))
        for a, b in zip(["", *x], x, strict=False):
            context = word[a] - own[a]
            after.append(min(max(stands[pair[a, b] - 1] - own_pair[a, b], 0), context) / context if context else 0)
            alone.append((word[b] - own[b] + 1) / (len(t.h) + len(words) + 1))
    assert got.count.tolist() == [word[w] for x in split for w in x] and got.after.tolist() == after and got.alone.tolist() == alone


def test_filter_returns_the_levels_it_was_given():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 48, 5000, dtype=np.uint64), rng.integers(1, 3000, 5000)
    words = language_model.CountFilter.segment(keys, counts, 1 << 20)
    f = language_model.CountFilter(1, np.array([0]), np.array([len(words)]), words)
    got = f.level(keys)
    assert (got >= language_model.levels(counts)).all() and (got == language_model.levels(counts)).mean() > 0.98
    assert (f.level(rng.integers(0, 1 << 48, 20000, dtype=np.uint64)) > 0).mean() < 0.02
    stands = language_model.level_counts()[language_model.levels(np.arange(1, 2000))]
    assert (np.abs(np.log(stands / np.arange(1, 2000))) < math.log(1.5)).all()


# --- classifiers ---


def test_the_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    m = quality_fm.FactorisationMachine.fresh()
    m.weight[:], m.bias = rng.normal(size=len(m.weight)), 0.3
    at, x = np.array([3, 70, 9, 3, 500]), rng.normal(size=5)
    got, _ = m.margins(np.array([0, 0, 0, 1, 1]), at, x)
    pairs = lambda r: sum(m.vectors[at[i]] @ m.vectors[at[j]] * x[i] * x[j] for i in r for j in r if i < j)
    want = [0.3 + sum(m.weight[at[i]] * x[i] for i in r) + pairs(r) for r in ([0, 1, 2], [3, 4])]
    assert got == pytest.approx(want, rel=1e-4)


def labelled(spark, rng, n, spoil):
    rows = [(i, (spoil(prose(rng, 60, 3000)) if i % 4 == 0 else prose(rng, 60, 3000)), "en") for i in range(n)]
    return docs(spark, rows + [(5000 + i, t, None) for i, t in enumerate(EDGES)])


def test_quality_is_told_on_held_out_texts(spark, space):
    rng = random.Random(11)
    table = labelled(spark, rng, 800, lambda t: t.upper().replace(" ", "!! "))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(800)], "doc_id long, quality int")
    found = quality_fm.scored(table, labels, space).collect()
    assert len(found) == 800 + len(EDGES) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    judged = [r.predicted == int(r.doc_id % 4 > 0) for r in found if r.held_out and r.doc_id < 800]
    assert sum(judged) >= 0.97 * len(judged)
    assert all(0.4 < r.score < 0.6 and r.predicted == 0 for r in quality_fm.scored(table.limit(5), labels.limit(0), space).collect())
    assert quality_fm.scored(docs(spark, []), labels, space).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé", max_size=8))
def test_automaton_meets_trie_as_edit_distance(word):
    terms = [("abcab", False, True), ("cabbac", False, True), ("bacaé", True, True), ("ab", False, False), ("aaaaa", False, False)]
    found = lexicon.Lexicon(terms).match(word)
    best = None
    for i, (t, stem, fuzzy) in enumerate(terms):
        d = min(distance(word[:n], t) for n in range(len(word) + 1)) if stem else distance(word, t)
        if d == 0 or d == 1 and fuzzy and len(t) >= 5:
            best = min(best or (9, 9), (d, i))
    assert found == (None if best is None else best[::-1])


def test_toxicity_is_told_on_held_out_texts(spark, space):
    rng = random.Random(12)
    endings = ["en", "er", "ung", "lich", "bar", "sam"]

    def spoil(text):
        w = text.split()
        for _ in range(2):
            w.insert(rng.randrange(len(w)), rng.choice(["idiotic", "worthless", "grumpf" + rng.choice(endings)]))
        return " ".join(w)

    table = labelled(spark, rng, 1200, spoil)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.scored(table, labels, space).collect()}
    judged = [found[i].predicted == int(i % 4 == 0) for i in range(1200) if found[i].held_out]
    assert sum(judged) >= 0.98 * len(judged)
    assert all(found[5000 + i].predicted == 0 for i in range(len(EDGES)))
    more = docs(spark, [(1, prose(rng, 50, 3000) + " worthles idi0tic " + prose(rng, 20, 3000), "en"), (2, prose(rng, 70, 3000), "en")])
    again = {r.doc_id: r.score for r in toxicity.scored(table.unionByName(more.withColumn("doc_id", F.col("doc_id") + 9000)), labels, space).where("doc_id > 9000").collect()}
    assert again[9001] > 0.5 > again[9002]
    assert toxicity.scored(docs(spark, [(1, "a", None)]), labels.limit(0), space).first().predicted == 0


def test_a_very_long_word_is_learnt_whole(spark, space):
    word = "ab" * 50_000
    sample = spark.createDataFrame([(f"{i} fine words here {i}" if i % 4 else f"{i} {word} {i + 1} bad {i + 2}", int(i % 4 == 0)) for i in range(200)], "text string, y int")
    terms = toxicity.learn_terms(sample, space)
    assert all(len(t) <= toxicity.LONGEST_STEM or t == word for t, _, _ in terms) and any(t in word for t, _, _ in terms)


def test_quoted_hits_are_told_apart():
    m = toxicity.Matcher([("worthless", False, 4.0)])
    texts = ['he called it "quite worthless" and left the old house again', "you are a worthless thing and always were one they think", "worthless", None]
    (t,) = v.pieces(pa.array(texts, pa.string()))
    x = m.features(t)
    assert (x[:, 1] > 0).tolist() == [False, True, True, False] and (x[:, 3] > 0).tolist() == [True, False, False, False]


@pytest.mark.parametrize("term, word", [("débile", "debile"), ("hässlich", "hasslich"), ("dämlich", "damlich"), ("pédophile", "pédophil"), ("pédophile", "pedophile"),
                                        ("идиот", "идот"), ("ばかやろう", "ばあやろう"), ("crétin", "cretin"), ("kz", "kz")])
def test_misspelt_letters_of_several_bytes_are_hits(term, word):
    m = toxicity.Matcher([(term, False, 4.0)])
    (t,) = v.pieces(pa.array([f"so ein {word} da"]))
    at, _, misspelt = m.hits(t, toxicity.cores(t))
    assert at.tolist() == [2] and misspelt.tolist() == [term != word]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abéあ", min_size=5, max_size=8), st.integers(0, 7), st.sampled_from(["", "x", "é", "あ"]), st.booleans())
def test_the_screen_loses_no_edit(term, at, letter, insert):
    word = term[:at] + letter + term[at + (not insert):]
    found = lexicon.Lexicon([(term, False, True)]).match(word)
    assert found is None or toxicity.Matcher([(term, False, 4.0)])._possible(word)
