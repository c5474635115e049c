"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retenta.llm.decontaminate import decontaminated
from retenta.llm.mixing import mixed
from retenta.llm.near_dedup import deduplicated
from retenta.llm.quality_rules import quality_filtered
from retenta.llm.token_files import token_digests, write_token_files
from retenta.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the cutoffs are set on the labelled ones among them."""
    return quality_filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Workspace(spark, "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return deduplicated(docs, Workspace(spark, "near-dedup"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "decontamination"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs, Workspace(spark, "mixing"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what is read back from them: a row per document and copy."""
    path = f"{Workspace(spark, 'token-files').folder}/tokens"
    write_token_files(docs, path)
    return token_digests(spark, path)


STAGES = [("quality", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing),
          ("token-files", token_files)]
#: The near-duplicate and token-file stages can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole ``documents`` table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = space.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
