"""Nulls, empty and very long texts, repeated rows, ids beyond 2**53, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewise.llm import attention, fingerprints, infilling, minhash, mixing, ngrams, pieces, pii, quality, suffixes, toxicity
from tests.llm.common import SCHEMA, edge_rows, edges, empty


def labelled(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") == 7, 9).otherwise(0).alias("toxic"))


OPERATORS = {
    "suffixes": suffixes.drop_repeats, "mixing": mixing.mixed_sizes, "quality": quality.score_quality, "pieces": pieces.encoded_sizes,
    "toxicity": lambda d: toxicity.score_toxicity(d, labelled(d)), "attention": attention.score_documents, "minhash": lambda d: minhash.near_duplicates(d, n=2),
    "fingerprints": fingerprints.fingerprint_edits, "pii": pii.find_personal_data,
    "ngrams": lambda d: ngrams.score_quality(d, labelled(d)), "infilling": infilling.fill_in_middle,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    made = OPERATORS[name](edges(spark)).collect()
    count = lambda rows: sorted((r is None, r or 0) for r in rows)
    assert count(r.doc_id for r in made) == count(r[0] for r in edge_rows())
    twice = [tuple(r) for r in made if r.doc_id == 2]
    same = {tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in twice} if name not in ("fingerprints", "mixing") else {0}
    assert len(twice) == 2 and len(same) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).collect() == []


@pytest.mark.parametrize("table", [edges, empty])
def test_stages_keep_columns_and_run_on_edges(spark, table):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        assert name == "sentencepiece" or made.columns == SCHEMA.fieldNames()
        rows = made.collect()
        docs = spark.createDataFrame(rows, made.schema)
    assert bool(rows) == (table is edges)
