"""The corpus pipeline: five stages over ``documents``, each written and read again.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of
documents. Language ID drops documents without a known language, SimHash near-dedup keeps
one document of each group, decontamination drops documents that hold a benchmark item,
PII masks what it finds, and packing returns the pieces of the training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsight.llm import decontaminate, language, packing, pii, simhash
from jobsight.llm.common import bounded_batches, rewritten, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", pack),
]

# Trained models and hash fingerprints: not expressible in SQL, tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = rewritten(docs)
    return docs
