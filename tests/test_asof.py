"""The as-of join against DuckDB, with ties, NULLs and a key that holds most of the rows."""

from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from retenta.operators import RunFolder, as_is, as_of_previous


@pytest.fixture
def tables(spark):
    def make(n, salt):
        h = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000))
        return spark.range(n).select(
            F.when(h < 900, F.lit(7)).when(h < 980, h % 9).cast("bigint").alias("k"),
            F.when(h % 17 != 0, F.expr("date'2026-01-01' + int(pmod(xxhash64(id), 90))")).alias("t"),
            F.col("id").alias("n"), F.concat(F.lit("x"), "id").alias("label"))

    return make(3000, 1), make(1500, 2).withColumnRenamed("t", "day")


def by_duckdb(left, right, sign):
    con = duckdb.connect()
    for name, df in (("l", left), ("r", right)):
        con.register(name, df.toPandas().astype({"k": "Int64"}))
    return con.execute(f"""
        SELECT l.k, l.t::DATE, l.n, l.label, r.best.n, r.best.label FROM l ASOF LEFT JOIN (
          SELECT k, day::DATE AS day, max(struct_pack(n := n, label := label)) AS best FROM r WHERE k IS NOT NULL AND day IS NOT NULL GROUP BY ALL
        ) r ON l.k = r.k AND l.t::DATE {sign} r.day""").fetchall()


@pytest.mark.parametrize("same_time", [False, True])
def test_as_of_equals_duckdb_with_a_hot_key_over_many_ranges(spark, tables, same_time):
    left, right = tables
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    stored = RunFolder.of_session(spark)
    seen = []
    got = as_of_previous(left, right, "k", "t", "day", ["n", "label"], {"n": "rn", "label": "rlabel"}, lambda df: seen.append(stored(df)) or seen[-1], same_time)
    assert got.columns == ["k", "t", "n", "label", "rn", "rlabel"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(by_duckdb(left, right, ">=" if same_time else ">"), key=repr)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spread = {r["_range"]: r["count"] for r in seen[0].filter("_key = 7").groupBy("_range").count().collect()}
    assert len(spread) == 4 and max(spread.values()) < 2200


def test_nothing_earlier_no_key_and_empty_sides(spark):
    schema = "k bigint, t date, n int"
    day = date(2026, 1, 1)
    left = spark.createDataFrame([(1, day, 1), (1, day + timedelta(9), 2), (None, day, 3), (1, None, 4), (2, day + timedelta(9), 5)], schema)
    right = spark.createDataFrame([(1, day, 10), (1, day + timedelta(1), 11), (None, day - timedelta(1), 12), (1, None, 13)], schema)
    stage = RunFolder.of_session(spark)
    run = lambda a, b: sorted(tuple(r) for r in as_of_previous(a, b, "k", "t", "t", ["n"], {"n": "m"}, stage).select("n", "m").collect())
    assert run(left, right) == [(1, None), (2, 11), (3, None), (4, None), (5, None)]
    assert run(left, right.limit(0)) == [(n, None) for n in range(1, 6)]
    assert run(left.limit(0), right) == []
    with pytest.raises(ValueError, match="stored"):
        as_of_previous(left, right, "k", "t", "t", ["n"], {"n": "m"}, as_is)
