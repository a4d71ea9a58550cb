"""Registered queries of the corpus operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import (
    decontamination,
    exact_dedup,
    hard_negatives,
    html_text,
    language_id,
    mixing,
    pii,
    prefix_trie,
    quality_rules,
    secrets,
    simhash,
    substring_dedup,
    toxicity,
)
from metricloom.llm.common import read
from metricloom.llm.oracle import SQL


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_id(read(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii(read(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, folder, "documents"))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.html_text(read(spark, folder, "pages"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(read(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing(read(spark, folder, "documents"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(read(spark, folder, "embeddings"), moved)
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    taken_over = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie.prefix_trie(read(spark, folder, "conversations"), taken_over)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_language_id,
        op3_simhash,
        op4_toxicity,
        op5_pii,
        op6_decontamination,
        op7_substring_dedup,
        op8_html_text,
        op9_secrets,
        op10_mixing,
        op11_quality_rules,
        op12_hard_negatives,
        op13_prefix_trie,
    )
}
ORACLE = {name: sql for name, sql in SQL.items() if name in QUERIES}
