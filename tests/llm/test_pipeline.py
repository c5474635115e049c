"""The pipeline against a plain Python version of it, and each query's registration."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from retenta.llm import near_dedup, token_files
from retenta.llm.queries import QUERIES
from retenta.llm.sql import STATEMENTS

from . import brute
from .test_native import shingles, water_fill

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(STATEMENTS) <= set(__spark_entry__.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs = docs[[not brute.base_failed(t) for t in docs.text]]  # too few labels for a cutoff
    docs = docs.sort_values("doc_id").reset_index(drop=True)
    classes = brute.near_duplicate_classes(list(docs.text))
    docs = docs[[c == i for i, c in enumerate(classes)]]
    items = [shingles(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    docs = docs[[not any(n and 5 * len(n & s) >= 4 * len(n) for n in items) for s in map(shingles, docs.text)]]
    sizes = Counter()
    for s, t in zip(docs.source, docs.text, strict=True):
        sizes[s] += len(brute.words(t))
    targets = water_fill(sizes)
    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    want, start = [], 0
    for r in docs.itertuples():
        rate = targets[r.source] / sizes[r.source]
        draw = int(hashlib.md5(f"0|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}|1".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        for _ in range(int(rate) + (draw < rate - int(rate))):
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want and len({r[0] for r in got}) > 80


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_near_dedup", "op4_suffix_dedup", "op9_quality_rules"):
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == n


def test_recall_of_candidates_at_the_wanted_similarity():
    rng = np.random.default_rng(3)
    met = 0
    for seed in range(300):
        ids = np.sort(rng.choice(1 << 40, 220, replace=False).astype(np.uint64))
        a, b = ids[:198], ids[22:]  # 176 of 220 shared: 0.8
        keys = [near_dedup.band_keys(near_dedup.signatures(1, np.zeros(len(x), np.int64), x, np.ones(len(x))))[0] for x in (a, b)]
        met += (keys[0] == keys[1]).any()
    assert met >= 0.985 * 300


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(STATEMENTS[name])
    columns = sorted(want.columns)
    rows = lambda x: sorted(map(repr, x))
    assert rows(map(tuple, QUERIES[name](spark, SF).select(columns).collect())) == rows(want.select(*columns).fetchall())
