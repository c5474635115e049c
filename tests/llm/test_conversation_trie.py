"""The conversation trie against a plain Python trie."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from retenta.llm import conversation_trie
from retenta.llm.workspace import Workspace

TURNS = "conv_id long, turn long, role string, text string, depth string, d long"


def brute(rows, block=1, shared=1):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        s = tuple(own.get(c - int(math.fmod(c, block)), [])[:h] + turns[h:])
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
        ends[s].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    ids = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ids(p)) for p, m in members.items()), key=repr)


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], TURNS)
    got = conversation_trie.prefix_trie(table, Workspace(spark, "test"), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    options.pop("most", None)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, **options)


def talks(rng, n, most=12):
    texts = ["é", "bb", "ééé", "", None, "c\nd"]
    return [(c, i, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(n) for i in range(rng.randrange(1, most))]


@pytest.mark.parametrize("most", [1, 7, 20_000])
def test_trie_equals_brute_force(spark, most):
    rng = random.Random(most)
    rows = talks(rng, 60)
    same = [(0, "user", "hello"), (1, "assistant", "hi"), (2, "user", "more"), (3, None, None)]
    rows += [(1000 + c, *t) for c in range(40) for t in same[:4 if c % 5 else 2]]  # copies, and prefixes of them
    rows += [(2000, i, "user", f"t{i}") for i in range(700)] + [(2001, i, "user", f"t{i}") for i in range(650)]  # two long ones
    rows += [(3000, None, "user", "no number"), (3000, 0, "user", "zero"), (3000, 0, "user", "zero"), (3000, 0, "assistant", "zero"), (3000, 0, None, "zero")]
    rows += [(None, 0, "user", "lost"), rows[0], rows[3]]
    check(spark, rows, most=most)
    if most == 7:
        check(spark, rows, most=most, block=100, shared=6)


def test_rebuilt_conversations_may_have_no_turns(spark):
    rows = [(c, i, "user", f"{c % 3}{i}") for c in [*range(1, 40), 200, 201, 250, 299, -5, -100, -150] for i in range(1 + abs(c) % 3)]
    check(spark, rows, most=5, block=100, shared=6)


def test_most_conversations_are_copies(spark):
    rows = [(c, i, "user", f"turn {i}") for c in range(400) for i in range(6)] + [(900 + c, i, "user", f"{c} {i}") for c in range(30) for i in range(3)]
    check(spark, rows, most=50)


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, i, "user", f"turn {i % 10}") for i in range(4000)] + [(c, i, "user", f"turn {i}") for c in range(30, 60) for i in range(4)]
    check(spark, rows, most=100, block=100, shared=6)


def test_an_empty_table_has_no_nodes(spark):
    table = spark.createDataFrame([], TURNS)
    assert conversation_trie.prefix_trie(table, Workspace(spark, "test"), block=100, shared=6).count() == 0
    check(spark, [(1, None, None, None)])
