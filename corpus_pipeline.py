"""A corpus pipeline: each stage works on all rows that the one before kept.

Language identification drops texts without a language, exact deduplication and near
deduplication keep one document of each group, decontamination drops documents that
hold a passage of the benchmark, and the rest is encoded and decoded.

In every stage: null and empty texts have no letter and go in the first one. Null identifiers are the least in exact
deduplication and the last to stay in near deduplication. Rows that share identifier and text are copies, of which one
stays. Texts of any length are read whole. An empty table gives an empty table, and an empty benchmark drops nothing. All
stages but the last keep all columns, whatever their names; the last returns identifier, number of tokens and digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmap.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from quillmap.plans.storage import fresh_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_documents(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, a similarity of 0.8 or more."""
    return near_dedup.without_near_duplicates(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(docs, path).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", first_copies),
    ("near_dedup", no_near_copies),
    ("decontamination", no_benchmark),
    ("bpe", encoded),
]

#: The first stage trains a network and the last runs a tokenizer, which SQL does not
#: express; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
