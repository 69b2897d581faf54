"""Corpus preparation in five stages, each over what the one before it kept.

Stages take any number of further columns, whatever their names, and empty
tables.  Rows with a null doc_id are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.llm import bpe, common, decontaminate, ngram_join, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; null and empty texts fail, repeated rows are judged each."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram similarity links (five words, 0.8): the smallest doc_id, then the smallest text hash.

    Of repeated rows one stays; rows without words are groups of their own.
    """
    return ngram_join.keep_one(docs, n=5, percent=80, null_ids_stay=False)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null texts stay, items without an id are searched as well."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars as it then is (null for null texts)."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to; null and empty texts have no ids."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", private_data_masked),
    ("byte-level BPE", encoded),
]

#: SQL has neither the hashes of the first stage nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again; what a stage no longer needs is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = common.settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:
            common.forget(docs)
        docs = done
    return docs
