"""Registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import best_fit_packing, chat_tree, compress_quality, conversation_trie, ctw_scoring, filter_audit, html_extract, latent_decontamination, line_dedup, mixing, quality_rules, simhash_dedup, substring_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scoring.ctw_scoring(_read(spark, sf_dir, "documents"))


def op2_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_quality.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return out.selectExpr("row.doc_id as doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.digest(_read(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(_read(spark, sf_dir, "pages"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.digest(_read(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.digest(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ctw_scoring, op2_compress_quality, op3_mixing, op4_chat_tree, op5_substring_dedup, op6_quality_rules, op7_html_extract, op8_latent_decontamination, op9_simhash_dedup, op10_line_dedup, op11_conversation_trie, op12_filter_audit, op13_best_fit_packing)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_tree": chat_tree.ORACLE, "op5_substring_dedup": substring_dedup.ORACLE, "op10_line_dedup": line_dedup.ORACLE, "op11_conversation_trie": conversation_trie.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
