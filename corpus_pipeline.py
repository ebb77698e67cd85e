"""The training-text pipeline over ``documents``: five stages, each a DataFrame to a DataFrame.

Every stage but the last returns the columns of its input, rows it rejects left out. A stage's result is
written before the next one reads it, so a lost executor costs one stage at most. Extra columns pass
through; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from outings.llm import bpe, decontaminate, langid, neardup, toxicity
from outings.llm.tables import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, without any letter, or unlike the learned texts of their length."""
    prototypes = langid.fit(docs, "lang")
    return langid.keep_identified(docs, prototypes, least=langid.least_cosines(docs, prototypes, "lang"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the models, learned from ``labels``, call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 80 % of their five-word shingles; rows without id stay."""
    groups = written(neardup.near_duplicates(docs, shingle=5, percent=80), "groups")
    kept = docs.join(groups.filter("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).unionAll(docs.filter("doc_id IS NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]
#: The stages' models cannot be expressed in SQL; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
