"""The ``opN_*`` queries: each operator bound to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, langid, lm, packing, quality, rules, sharding, simhash, toxicity
from .common import table


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), ["n_chars", "lang", "source", "doc_id"], leaves=40)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_kd_tree_sharding": op1_kd_tree_sharding,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
}

ORACLE_SQL = {
    "op7_benchmark_decontamination": decontam.ORACLE_SQL,
}
