"""A corpus pipeline over ``documents``: reject, deduplicate, decontaminate, redact, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.classifier import keep_quality
from paperloom.llm.common import settled, table
from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.jaccard import keep_one
from paperloom.llm.mixing import mix
from paperloom.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), "quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id."""
    return keep_one(docs, percent=75, width=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: The classifier and the hash thresholds have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
