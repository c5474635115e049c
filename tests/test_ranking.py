"""Numbers within a key against a plain window, with a key that holds most of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retenta.operators import RunFolder, as_is, ordinal


def test_ordinal_equals_a_plain_window_under_skew(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 < 8, F.col("id") % 50).cast("bigint").alias("k"),
        F.when(F.col("id") % 11 != 0, F.expr("date'2026-01-01' + int(id * 7919 % 300)")).alias("d"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("m"), F.col("id") % 3)).alias("m"),
        "id",
    )
    plain = frame.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("d", "m", "id")).cast("bigint"))
    got = ordinal(frame, "k", ["d", "m"], "id", "n", RunFolder.of_session(spark))
    assert got.columns == plain.columns
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    assert got.filter("k IS NULL").count() > 0
    with pytest.raises(ValueError, match="stored"):
        ordinal(frame, "k", ["d", "m"], "id", "n", as_is)


def test_a_hot_key_and_sparse_ids_are_spread_over_the_ranges(spark):
    frame = spark.range(4000).select(
        F.when(F.col("id") % 10 > 0, F.lit(7)).cast("bigint").alias("k"), F.lit("d").alias("d"), F.xxhash64("id").alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    seen = []
    stage = RunFolder.of_session(spark)
    got = ordinal(frame, "k", ["d"], "id", "n", lambda df: seen.append(stage(df)) or seen[-1])
    assert [tuple(r) for r in got.groupBy("k").agg(F.min("n"), F.max("n"), F.count_distinct("n")).orderBy("k").collect()] == [
        (None, 1, 400, 400), (7, 1, 3600, 3600)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 2 and seen[1].columns == ["k", "d", "id", "_salt", "_range"]  # only what is ordered is dealt
    largest = max(r["count"] for r in seen[1].filter("k = 7").groupBy("_range").count().collect())
    assert largest < 2000
