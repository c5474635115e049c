"""Mixing, decontamination and chat formatting: edge cases, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from retenta.llm import chat, decontaminate, mixing
from retenta.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"


@pytest.fixture
def space(spark):
    return Workspace(spark, "test")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "x") for i, t, s in rows], DOCS)


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = {}, set(names)
    while left:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        left -= over
    return target


def test_targets_equal_repeated_resharing(spark, space):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {s: rng.choice([0, 3, 50, 1000, 20000]) for s in ["a", "b", "ä", "Z", "z", None, ""]}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mixing_plan_and_emitted_rows_agree(spark, space):
    rows = [(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(400)] + [(1000, None, "a"), (1001, "", None), (1001, "x\ty\n", None), (None, "q", "b")]
    table = docs(spark, rows)
    plan = mixing.mixing_plan(table, space)
    per_row = plan.collect()
    assert len(per_row) == len(rows) and all(r.taken <= 3 * r.size for r in per_row)
    for size in {r.source_size for r in per_row}:
        mine = [r for r in per_row if r.source_size == size]
        assert size < 10 or sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.2)
    emitted = mixing.mixed(table, space)
    assert emitted.columns == table.columns
    counts = {(r.doc_id, r.text): r["count"] for r in emitted.groupBy("doc_id", "text").count().collect()}
    want = {}
    for r in per_row:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for (i, _), n in counts.items():
        got[i] = got.get(i, 0) + n
    assert {k: n for k, n in want.items() if n} == got
    assert mixing.mixing_plan(table.limit(0), space).count() == 0


def test_rows_without_ids_meet_their_target(spark, space):
    rows = [(None, "ten words in each text of the rows without ids", "a")] * 300 + [(None, f"text {i} has six words, always", "b") for i in range(300)]
    rows += [(7, "one two three four five six seven eight nine ten", "c")] * 200
    table = docs(spark, rows)
    per_row = mixing.mixing_plan(table, space).collect()
    for target in {r.target for r in per_row}:
        assert sum(r.taken for r in per_row if r.target == target) == pytest.approx(target, rel=0.1)
    key = lambda r: (r.size, r.source_size)
    counts = lambda found: sorted((*key(r), r.copies) for r in found)
    assert counts(per_row) == counts(mixing.mixing_plan(table.repartition(5), space).collect())
    emitted = mixing.mixed(table.repartition(2), Workspace(spark, "again"))
    assert emitted.count() == sum(r.copies for r in per_row) and emitted.columns == table.columns


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def test_contamination_equals_brute_force(spark, space):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 6, 12, 30, 31, 64, 200, 500])] + [(90, None), (91, "")]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 300))]
        _, item = items[rng.randrange(9)]
        words = item.split()
        for _ in range(rng.randrange(4)):  # edits, so that some stay above and some fall below the share
            words[rng.randrange(len(words))] = word()
        if i % 3:
            text[5:5] = words
        rows.append((i, " ".join(text).upper() if i % 5 == 0 else "\n".join(text), "s"))
    rows += [(7, rows[7][1], "s"), (None, items[5][1], "s"), (500, None, "s"), (501, "", "s"), (502, items[7][1] * 3, "s")]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contaminated(docs(spark, rows), bench, space).collect()}
    by_id = {}
    for i, t, _ in rows:
        by_id.setdefault(i, set()).update(shingles(t))
    want = {}
    for i, s in by_id.items():
        for j, t in items:
            n = shingles(t)
            if n and 5 * len(n & s) >= 4 * len(n):
                want[i, j] = (len(n), len(n & s))
    assert got == want and len(want) > 30 and any(k[0] is None for k in want)
    kept = decontaminate.decontaminated(docs(spark, rows), bench, space)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _ in rows if i not in {k[0] for k in want})
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0), space).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench, space).count() == 0


def test_an_empty_benchmark_keeps_all(spark, space):
    bench = spark.createDataFrame([], "item_id long, text string")
    table = docs(spark, [(1, "a b c d e f", "s"), (None, None, None)])
    assert decontaminate.decontaminated(table, bench, space).count() == 2


TURNS = "conv_id long, turn long, role string, text string, part string"


def test_only_maximal_conversations_are_rendered(spark, space):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = [(1, i, *talk[i], "x") for i in range(2)] + [(2, i, *talk[i], "x") for i in range(4)] + [(3, i, *talk[i], "x") for i in range(4)]
    rows += [(4, 10 * i, *talk[i], "x") for i in range(3)]  # other turn numbers, the same turns
    rows += [(5, 0, "user", "hi", "x"), (5, 1, "assistant", "other", "x")]
    rows += [(2, 0, "user", "hi", "y")]  # a repeated row
    rows += [(None, 0, None, "lost", "x"), (6, None, "user", "no number", "x"), (6, 0, "user", "zero", "x")]
    rows += [(7, i, "user", f"t{i}", "x") for i in range(2500)]
    got = {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat.rendered(spark.createDataFrame(rows, TURNS), space).collect()}
    assert {k[0] for k in got} == {2, 5, None, 6, 7}
    assert got[2, 0] == (4, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\n<|end|>\n")
    assert got[None, 0] == (1, "<|unknown|>\nlost<|end|>\n")
    assert [got[7, p][0] for p in range(3)] == [2500] * 3
    assert "".join(got[7, p][1] for p in range(3)) == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(2500))
    assert got[6, 0] == (2, "<|user|>\nno number<|end|>\n<|user|>\nzero<|end|>\n") and (6, -1) not in got
    assert chat.rendered(spark.createDataFrame([], TURNS), space).count() == 0


def test_parts_count_turns_and_not_their_numbers(spark, space):
    rows = [(1, n, "user", f"t{i}", "x") for i, n in enumerate([0, 5000, 10000, -7])]
    got = chat.rendered(spark.createDataFrame(rows, TURNS), space).collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 4)]
    assert got[0].text == "".join(f"<|user|>\nt{i}<|end|>\n" for i in (3, 0, 1, 2))


def test_role_and_text_are_hashed_apart(spark, space):
    rows = [(1, 0, "user\nx", "y", "x"), (2, 0, "user", "x\ny", "x"), (3, 0, "user", "x\ny", "x")]
    assert sorted(r.conv_id for r in chat.rendered(spark.createDataFrame(rows, TURNS), space).collect()) == [1, 2]


def test_most_turns_have_no_conversation_and_no_number(spark, space):
    rows = [(None, None if i % 2 else i, "user", f"t{i}", "x") for i in range(3600)] + [(c, i, "user", f"t{i}", "x") for c in range(100) for i in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = chat.placed_turns(spark.createDataFrame(rows, TURNS), space)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    own = placed.where("conv_id is null")
    assert own.agg(F.min("k"), F.max("k"), F.count_distinct("k")).collect()[0] == (1, 3600, 3600)
    got = chat.rendered(spark.createDataFrame(rows, TURNS), space).collect()
    assert sorted((r.conv_id is None, r.part) for r in got) == [(False, 0), *((True, i) for i in range(4))]
    assert sum(r.text.count("<|end|>") for r in got) == 3604


def test_numbers_and_hashes_follow_the_turns(spark, space):
    rows = [(1, 700 * i, "user", f"t{i}", "x") for i in range(5)]
    hashes = chat.prefix_hashes(chat.placed_turns(spark.createDataFrame(rows, TURNS), space)).orderBy("k").collect()
    assert [r.k for r in hashes] == [1, 2, 3, 4, 5] and len({(r.p, r.q) for r in hashes}) == 5


def test_shares_are_even(spark):
    shares = [r.x for r in spark.range(2000).select(mixing.hashed_share(0, F.col("id")).alias("x")).collect()]
    assert 0 <= min(shares) and max(shares) < 1 and abs(sum(shares) / 2000 - 0.5) < 0.03
