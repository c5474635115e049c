"""Runs registered queries beside their oracle: ``python -m verification.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from glob import glob
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from . import oracle, registry


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _rows(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns and rows in any order, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    spark_rows, sql_rows = _rows(df.collect(), df.columns), _rows(result.fetchall(), names)
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows, oracle {len(sql_rows)}"
    columns = sorted(names)
    for a, b in zip(spark_rows, sql_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return str([(c, x, y) for c, x, y in zip(columns, a, b) if x != y or type(x) is not type(y)])
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = oracle_connection(sf_dir), oracle.statements(), 0
    for name, query in registry.registered().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            found = "no oracle" if name not in sql else difference(df, con, sql[name])
            count = df.count()
        except Exception as error:  # report and go on with the next query
            found, count = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name}: {count} rows, {time.time() - start:.1f}s {found or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
