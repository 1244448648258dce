"""The registered query of each operator, with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import attention, chat, fingerprints, infilling, minhash, mixing, ngrams, pieces, pii, quality, spelling, suffixes, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.conversation_digests(rows.unionByName(extra))


ORACLES["op1_chat_format"] = chat.CHAT_SQL


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digests, what is removed and the text that is left (cut characters give way to U+FFFD)."""
    made = suffixes.drop_repeats(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


ORACLES["op3_mix_sources"] = mixing.MIX_SQL.format(documents="documents")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op7_attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score_documents(documents(spark, sf_dir))


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), n=2)


ORACLES["op8_minhash_near_dedup"] = minhash.NEAR_SQL.format(n=2, percent=80)


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_sizes(documents(spark, sf_dir))


@query
def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.fill_in_middle(documents(spark, sf_dir))
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = infilling.FIM_SQL


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))
