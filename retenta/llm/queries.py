"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_trie, decontaminate, language_model, mixing, near_dedup, quality_fm, quality_rules, repeats, resampling, token_files, top_k, toxicity
from .workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"), Workspace(spark, "op1"))
    return found.select("doc_id", "class_id", "class_texts")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op2")
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), space)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = ~language_model.held_out(F.col("doc_id"), 7, 2)
    return language_model.scored(table(spark, sf_dir, "documents"), training, Workspace(spark, "op3"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"), Workspace(spark, "op5"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op6"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op7"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'op8').folder}/tokens"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.token_digests(spark, path)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op9"))
    return found.drop("n_lines", "n_capitals", "n_letters")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents"), Workspace(spark, "op10"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op11"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), Workspace(spark, "op12"), block=100, shared=6)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Workspace(spark, "op13"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_lm_scoring, op4_suffix_dedup, op5_chat_formatting, op6_quality_classifier, op7_toxicity,
                                op8_token_files, op9_quality_rules, op10_source_mixing, op11_importance_resampling, op12_conversation_trie, op13_exact_top_k)}
