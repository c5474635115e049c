"""Report tables: parquet, one partition per reported period.

A period is written by replacing its own partition, so running a month twice leaves one copy and the
other months are untouched. New rows are written beside the old ones and take their place when they are complete, so a
run that fails leaves the old ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARTITION, REMOVAL = "report_period", "removal"
_ALL = (1 << 64) - 1


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The target's columns by name, in its order and types; other columns are left out."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(PARTITION, StringType())])


def replace_folder(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write ``df`` to ``path`` in place of what stands there, once it is complete.

    It is written to a folder beside ``path`` whose name readers skip. A reader that comes between the removal of the old
    folder and the renaming of the new one finds neither; one that fails to write changes nothing.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    beside = f"{parent}/_new-{uuid.uuid4().hex}"
    fs, place = _hadoop(df.sparkSession, path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    try:
        writer.parquet(f"{beside}/{name}")
        fs.delete(place(path), True)
        fs.mkdirs(place(parent))
        if not fs.rename(place(f"{beside}/{name}"), place(path)):
            raise OSError(f"{path} could not be replaced; the new rows are in {beside}/{name}")
    except Exception:
        if fs.exists(place(path)):
            fs.delete(place(beside), True)
        raise
    fs.delete(place(beside), True)


def replace_folders(df: DataFrame, path: str, level: str, label: str, names: Mapping[str, str]) -> None:
    """Write the tables that ``df`` holds in one, by one job, in place of what stands below ``path``.

    A row belongs to the table its column ``level`` names, and to the partition ``label`` there. ``names`` gives the partition
    column of each table: rows of ``t`` come to ``path/t/<names[t]>=<label>``. A table without rows is an empty folder. Labels are plain text
    that needs no escaping. As in ``replace_folder``, all is written before the first table is replaced.
    """
    root = path.rstrip("/")
    beside = f"{root}/_new-{uuid.uuid4().hex}"
    fs, place = _hadoop(df.sparkSession, root)
    try:
        df.write.option("compression", "zstd").partitionBy(level, label).parquet(f"{beside}/all")
        for table, name in names.items():
            written, made = place(f"{beside}/all/{level}={table}"), f"{beside}/{table}"
            fs.mkdirs(place(made))
            for part in fs.listStatus(written) if fs.exists(written) else ():
                value = part.getPath().getName().partition("=")[2]
                _renamed(fs, part.getPath(), place(f"{made}/{name}={value}"))
        for table in names:
            fs.delete(place(f"{root}/{table}"), True)
            _renamed(fs, place(f"{beside}/{table}"), place(f"{root}/{table}"))
    except Exception:
        if all(fs.exists(place(f"{root}/{table}")) for table in names):
            fs.delete(place(beside), True)
        raise
    fs.delete(place(beside), True)


def _renamed(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"{old} could not be renamed to {new}")


def _hadoop(spark: SparkSession, path: str):
    """The file system of ``path``, and how it names places."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def create_or_replace(df: DataFrame, path: str) -> None:
    """The whole table anew from a query result."""
    replace_folder(df, path)


def append_period(df: DataFrame, schema: StructType, path: str, period: str) -> None:
    """Add one period's rows; a re-run replaces that period only, also by no rows at all."""
    replace_folder(typed(df, schema), f"{path}/{PARTITION}={period}")


def read_report(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """A stored report with its period column as text (``2606`` must not come back as a number)."""
    return spark.read.schema(_stored(schema)).parquet(path)


def rewrite_without(
    kept: DataFrame, removed: DataFrame, schema: StructType, path: str, period: str, audit_path: str
) -> None:
    """Replace a period by its kept rows and add the removed rows to those kept for review.

    ``kept`` may be read from that period: both halves are written to the audit place first, and the period is rewritten
    from there. Removed rows stand in a folder named after their number and content, so a run that is repeated, after a
    failure or over a profile made anew, leaves them once; one that finds none leaves the earlier ones.
    """
    spark = kept.sparkSession
    kept_path, removed_path = f"{audit_path}/kept/{period}", f"{audit_path}/removed/{period}"
    gone = typed(removed, schema)
    rows = F.xxhash64(*gone.columns)
    n, low, high = gone.agg(F.count(F.lit(1)), F.bit_xor(rows), F.bit_xor(F.xxhash64(rows, F.lit(1)))).first()
    if n:
        replace_folder(gone, f"{removed_path}/{REMOVAL}={n}-{(low or 0) & _ALL:016x}{(high or 0) & _ALL:016x}")
    replace_folder(typed(kept, schema), kept_path)
    append_period(spark.read.schema(schema).parquet(kept_path), schema, path, period)
