"""A training corpus from documents: quality, near-duplicates, benchmark leaks, secrets, packing.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Labels and benchmark items are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from posthound.llm import importance, neardup, packing, secretcrf, templates
from posthound.session import mark, release, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; rejected ones go."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more): that of the smallest id."""
    return neardup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secretcrf.redact(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("mixture_packing", mixture_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since, mark() - 1)  # what the stage itself wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the hashed models nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None
