"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import top_k
from retenta.llm.workspace import Workspace

VECTORS = "vec_id long, embedding array<double>, label string, score long, query boolean"


def brute(rows, k=5, every=50):
    able = []
    for i, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) and math.isfinite(256 * c) for c in x):
            able.append((i, [math.floor(256 * c) for c in x]))
    out = []
    for a, (i, q) in enumerate(able):
        if i is not None and i % every == 0:
            found = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(able) if a != b]
            out += [(i, n, j, max(-2 ** 63, min(2 ** 63 - 1, -s))) for n, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(i, x, "a", 3, True) for i, x in rows], VECTORS).repartition(parts)
    got = top_k.top_k(table, F.col("vec_id") % 50 == 0, Workspace(spark, "test"), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, options.get("k", 5))


@pytest.mark.parametrize("shard,group", [(8192, 8192), (30, 3)])
def test_top_k_equals_brute_force(spark, shard, group):
    rng = random.Random(shard)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)]) for i in range(400)]
    rows += [(1000, None), (1001, [0.1, None]), (1050, [float("nan")] * 8), (1100, [float("inf")] + [0.0] * 7), (1150, []), (1200, [0.0] * 8), (1250, [1e306] * 8)]
    rows += [(None, [0.9] * 8), (None, [0.9] * 8), (50, rows[50][1]), (50, rows[50][1]), (7, rows[9][1]), (1300, [0.5, -0.5]), (1301, [0.5] * 11)]
    check(spark, rows, shard=shard, group=group)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [0.25, -0.5, 0.0]) for i in range(900)] + [(2000 + i, [0.25, -0.5, i / 1000]) for i in range(60)]
    check(spark, rows, shard=100, k=7)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    for bits in (20, 22):  # scores beyond the whole numbers that a double holds; products that 62 bits may not hold
        rows = [(10 * i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(bits) + rng.random() for _ in range(4)]) for i in range(60)]
        check(spark, rows, shard=20)
    table = spark.createDataFrame([(i, [1e300 * (i % 2), 1.0], "a", 3, True) for i in range(60)], VECTORS)
    got = top_k.top_k(table, F.col("vec_id") % 25 == 0, Workspace(spark, "test")).where("query_id = 25").collect()
    assert [r.score for r in got] == [2 ** 63 - 1] * 5


def test_few_or_no_rows(spark):
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])])
    check(spark, [(1, [1.0, 2.0])])
    assert top_k.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0, Workspace(spark, "test")).count() == 0


def test_search_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (5000, 3))
    v[17] = [400, 400, 400]
    v[18], v[19] = v[17] - 1, v[17] - 2
    rows, scores, scored = top_k.Lists(v).best(np.array([3, 5, 1]), 3, None, np.arange(5000))
    assert rows.tolist() == [17, 18, 19] and scores.tolist() == [3600, 3591, 3582] and scored < 200
