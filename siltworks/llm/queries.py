"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import hilbert, lengths, mixing, neardup, packing, passages, phrases, pulearn, render, repair, rules, tokenfiles, whitening
from siltworks.session import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_lengths(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edit_robustness(table(spark, sf_dir, "documents"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


def op8_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract_text(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.encoded_and_read(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_source_mixing": op5_source_mixing,
    "op6_phrase_fingerprints": op6_phrase_fingerprints,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_visible_text": op8_visible_text,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_files": op12_token_files,
    "op13_conversation_repair": op13_conversation_repair,
}

#: SQL for those that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op5_source_mixing": mixing.ORACLE_SQL,
}
