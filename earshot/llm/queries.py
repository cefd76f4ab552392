"""The queries of this package for ``__spark_entry__.py``, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import decontaminate, fingerprint, langid, linededup, mixing, neardup, quality, secrets, sharding, substrings


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents").select("doc_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_language_id, op3_line_dedup, op4_secret_scan, op5_substring_dedup, op6_source_mixing, op7_decontamination, op8_quality, op9_fingerprints, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """SQL for the four that it can express; the rest are tested against brute force, round trips or held-out rows."""
    return {"op1_sharding": sharding.oracle(), "op3_line_dedup": linededup.ORACLE_SQL, "op5_substring_dedup": substrings.oracle(), "op7_decontamination": decontaminate.oracle()}
