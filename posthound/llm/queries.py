"""The registered queries of the training-data operators: production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from posthound.llm import crosspolytope, divergence, hilbert, importance, langid, merkle, neardup, packing, replytrees, secretcrf, suffixdedup, templates, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretcrf.secrets(_table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(_table(spark, sf_dir, "embeddings"), queries="id % 50 = 0", k=5)


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replytrees.query(_table(spark, sf_dir, "conversations"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), even=True)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.accepted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign_shards(_table(spark, sf_dir, "documents"), shards=24)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("path")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_crf, op2_cross_polytope, op3_template_decontamination, op4_reply_trees, op5_minhash_near_dedup, op6_language_centroids, op7_mixture_packing, op8_importance_resampling, op9_url_rules, op10_hilbert_shards, op11_merkle_manifest, op12_source_divergence, op13_suffix_dedup)}

ORACLE_SQL: dict[str, str] = {"op4_reply_trees": replytrees.ORACLE_SQL, "op5_minhash_near_dedup": neardup.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
