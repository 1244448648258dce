"""The pipeline next to a plain version of each stage over the same documents."""

import collections
import hashlib
import importlib.util
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from framewise.llm import pii, quality
from framewise.llm.pieces import Encoder, PieceModel
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import by_resharing
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    docs = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()
    f = quality._features([d[1].encode() for d in docs])
    votes = quality._votes(f, quality.RULES)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    kept = quality.judge(f, quality.fit_label_model(patterns.astype(float), n.astype(float)))["kept"]
    docs = [d for d, k in zip(docs, kept, strict=True) if k]
    stay = {i for i, _, c in brute([d[:2] for d in docs], 5) if i == c}
    docs = [(i, pii.redact(t), g, s) for i, t, g, s in docs if i in stay]
    size = {d[0]: len(d[1].encode().split()) for d in docs}
    sizes = collections.Counter()
    for d in docs:
        sizes[d[3]] += size[d[0]]
    target, times = by_resharing(sizes), {}
    for s in sizes:
        whole = int(target[s] // sizes[s] + 1e-12) if sizes[s] else 0
        rest, reach = target[s] - whole * sizes[s], 0
        own = sorted((int(hashlib.md5(f"{d[0]}:{d[1]}".encode()).hexdigest()[:12], 16), d[0]) for d in docs if d[3] == s)
        for _, i in own:
            times[i] = whole
            if size[i] and (reach + size[i] <= rest or (reach <= rest and reach + size[i] - rest < rest - reach)):
                times[i] += 1
            reach += size[i]
    model = PieceModel.load()
    want = collections.Counter()
    for i, t, g, s in docs:
        ids, _ = Encoder(model).encode([t])
        want[(i, g, s, tuple(ids.tolist()))] += times[i]
    got = collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op") and n[2].isdigit()])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted("|".join(canon(r[c]) for c in cols) for r in df.collect()) == sorted("|".join(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))


def test_nothing_else_imports_the_subpackage():
    out = subprocess.run(["grep", "-rlE", r"framewise\.llm|from framewise import llm|corpus_pipeline", "framewise", "bench.py", "tests", "--include=*.py", "--exclude-dir=llm"],
                         capture_output=True, text=True, cwd=importlib.util.find_spec("__spark_entry__").origin.rpartition("/")[0])
    assert out.stdout == "", sys.path
