"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

Quality rules reject documents; of each class of near-duplicates one document stays; secrets are
masked; sources are mixed to their target weights, so documents may repeat or go; the last stage
encodes what is left.  All stages but the last return the columns of `documents`.

The fifth stage returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import bpe, jaccard_join, mixing, quality, secret_scan, textkit


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return bpe.token_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: None of the stages can be stated in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = textkit.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
