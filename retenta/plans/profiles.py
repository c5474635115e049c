"""Columns both yearly profiles share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..vocab import DEFAULT_VOCABULARY, NO_DATA, Vocabulary


def region_columns(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Three readings of ``region``: cleaned, grouped and classed."""
    region = F.col("region")
    missing = region.isNull() | region.isin(*vocab.region_no_data)
    return df.withColumns({
        "region_1": F.when(missing, NO_DATA).otherwise(region),
        "region_2": classify(vocab.region_groups, otherwise=NO_DATA),
        "region_3": classify(vocab.region_classes, otherwise=NO_DATA),
    })


def with_region(df: DataFrame, zip_regions: DataFrame) -> DataFrame:
    """Left join of the region on the code's first two characters and its class (old or new)."""
    lookup = zip_regions.select(
        F.col("zip_code").alias("_zip_code"), F.col("gb").alias("_zip_class"), "region"
    )
    on = (F.substring("all_zip", 1, 2) == F.col("_zip_code")) & (F.col("zip_gb") == F.col("_zip_class"))
    return df.join(lookup, on, "left").drop("_zip_code", "_zip_class")
