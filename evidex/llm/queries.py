"""The numbered operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fim, fingerprint, histogram_sort, langid, mixing, resampling, sanitise, simhash, templates, token_scan, turn_repair
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(spark, sf_dir)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(spark, sf_dir)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_documents(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.quality_documents(spark, sf_dir)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_pages(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_documents(table(spark, sf_dir, "documents"))


def op13_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.private_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_chat_formatting, op3_document_fingerprints, op4_token_counts, op5_sharding, op6_decontamination, op7_simhash_dedup, op8_source_mixing,
        op9_quality_resampling, op10_html_extraction, op11_conversation_repair, op12_fill_in_middle, op13_sanitisation,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.SQL, "op6_decontamination": decontam.SQL, "op8_source_mixing": mixing.SQL, "op11_conversation_repair": turn_repair.SQL, "op12_fill_in_middle": fim.SQL}
