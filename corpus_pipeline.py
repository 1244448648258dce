"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import minhash, mixing, pieces, pii, quality
from framewise.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or have a posterior quality under one half go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, 0.8 or more of their union."""
    return minhash.drop_near_duplicates(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as its source's target takes it, up to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return pieces.encode_documents(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: EM, the further spans and the best pieces are beyond SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; a table in the shared folder stands between any two.

    Each stage's docstring says what it does with nulls, empty and repeated rows; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/framewise-pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{k}-{name}")
    return docs
