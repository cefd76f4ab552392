"""The corpus pipeline: language ID, near-deduplication, benchmark decontamination, source mixing and sharding of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import decontaminate, langid, mixing, neardup, sharding
from earshot.storage import remove, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go. Null and blank texts do too, and all where no row has a label; equal rows stay or go together, null ids by their texts; an empty table stays empty."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least id; rows without an id or a word stay too, and rows of one id with unlike texts; an empty table stays empty."""
    return neardup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. With an empty benchmark all stay, and so do null and blank texts; items that are null or without words are held by nothing; equal rows stay or go together, null ids by their texts."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that each source has its target share; a null source is a source of its own, null ids and texts are as others, and equal rows each have copies of their own; an empty table stays empty."""
    return mixing.mix_sources(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay and get their region, rack and shard, in place of columns of these names. Rows of one id go to one shard; null ids count as one id of their own; texts don't matter."""
    return sharding.shard(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("source_mixing", mix_sources), ("sharding", assign_shards)]

#: SQL has no counterpart of a kernel classifier, connected components of MinHash pairs, or pivotal rounding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next, which leaves it to be deleted."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
