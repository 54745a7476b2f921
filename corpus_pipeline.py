"""A training corpus from ``documents``: quality rules, near-duplicate removal, benchmark decontamination,
secret scans, packing.

Each stage works on what its predecessor kept, written as Parquet to the shared folder and read again.  All but
the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftscope.llm.decontam import clean_documents
from shiftscope.llm.line_quality import good_documents
from shiftscope.llm.near_dedup import unique_documents
from shiftscope.llm.packing import packed_documents
from shiftscope.llm.secrets import without_secrets
from shiftscope.llm.shared import stash
from shiftscope.session import sf_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by lines common in their source, without these lines."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return unique_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return clean_documents(docs, spark.read.parquet(sf_path(sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontamination),
          ("secret scan", secret_scan), ("packing", packing)]

#: a tokenizer's ids are not expressible in SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(sf_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
