"""Named sources: parquet paths, CSV uploads, catalog tables or JDBC tables behind one lookup."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .schemas import TABLES


class SchemaMismatch(ValueError):
    """A source lacks a declared column or holds it in another type."""


def conform(df: DataFrame, schema: StructType, name: str = "table") -> DataFrame:
    """Select the declared columns in order; raise at once if one is missing or of another type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in actual]
    wrong = [
        f"{f.name} is {actual[f.name].simpleString()}, declared {f.dataType.simpleString()}"
        for f in schema.fields
        if f.name in actual and actual[f.name] != f.dataType
    ]
    if missing or wrong:
        raise SchemaMismatch(f"{name}: missing {missing}, mistyped {wrong}")
    return df.select(*schema.fieldNames())


@dataclass
class Sources:
    """Maps table names to places.

    A place is a parquet path (text), or a mapping with ``format`` (``parquet``, ``csv``, ``jdbc``,
    ``table``) and its options; ``columns`` renames source columns to the declared ones. CSV uploads are
    read as text under the declared names and cast. JDBC needs the driver on the cluster; give it
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read in parallel.
    """

    spark: SparkSession
    places: Mapping[str, str | Mapping[str, Any]]
    schemas: Mapping[str, StructType] = field(default_factory=lambda: TABLES)

    def __getitem__(self, name: str) -> DataFrame:
        place = self.places[name]
        spec = {"format": "parquet", "path": place} if isinstance(place, str) else dict(place)
        schema = self.schemas[name]
        kind, renames, options = spec.pop("format"), spec.pop("columns", {}), spec.pop("options", {})
        if kind == "csv":
            return self._csv(spec["path"], schema, renames, options)
        if kind == "parquet":
            df = self.spark.read.options(**options).parquet(spec["path"])
        elif kind == "table":
            df = self.spark.table(spec["name"])
        elif kind == "jdbc":
            df = self.spark.read.format("jdbc").options(**options).load()
        else:
            raise ValueError(f"{name}: unknown format {kind!r}")
        if renames:
            df = df.withColumnsRenamed(renames)
        return conform(df, schema, name)

    def _csv(self, path: str, schema: StructType, renames: Mapping[str, str], options: Mapping[str, str]) -> DataFrame:
        header = {new: old for old, new in renames.items()}
        text = StructType([StructField(header.get(f.name, f.name), StringType()) for f in schema.fields])
        df = self.spark.read.options(header=True, enforceSchema=False, **options).schema(text).csv(path)
        return df.select(*[F.col(header.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def register_views(self, *names: str) -> None:
        """Replace the temporary views of these tables, for ad-hoc SQL."""
        for name in names:
            self[name].createOrReplaceTempView(name)
