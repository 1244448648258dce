import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from framewise.llm import spelling
from framewise.llm.queries import QUERIES
from tests.llm.common import edge_rows, edges, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 2}


def brute(n):
    """All words with all words of nearly the same length."""
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_variants_of_a_dense_vocabulary(spark):
    """Few letters, capitals of both kinds, chains of forms of three steps and ties."""
    rng = random.Random(11)
    base = ["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "Éaaaaaaa", "éaaaaaaa", "ÉAAaaaaa", "STRASSEß", "straßeß×", "÷ÿþðabcd", "abcdefgh", "abcdefg", "bcdefgh", "abcdegh", "xabcdefgh", "abxcdefgh", "abcdefghx", "abcxefgh"]
    base += ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(250)]
    words = [w for k, w in enumerate(base) for _ in range(1 + 11 ** (k % 4) // 3)]
    words += ["chaining"] * 3000 + ["chainin"] * 290 + ["chanin" + "x"] * 28 + ["chaninxq"] * 2
    rng.shuffle(words)
    rows = [(k, rng.choice([" ", "-", "7", "_"]).join(words[k * 40 : k * 40 + 40])) for k in range(-(-len(words) // 40))]
    made = got(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = brute(counted(rows))
    assert made == want
    chain = {w: (f, r) for w, f, r, *_ in want}
    assert any(f and f != r for f, r in chain.values()) and max(x[4] for x in want) > 5


@pytest.mark.parametrize("symbols", ["0", "01"])
def test_result_does_not_depend_on_symbols(spark, symbols, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("xyzw") for _ in range(rng.randrange(7, 10))) for _ in range(60))) for i in range(20)] * 2
    monkeypatch.setattr(spelling, "SYMBOLS", symbols)
    assert got(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(counted(rows))


def test_query_on_a_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    made = got(QUERIES["op13_spelling_variants"](spark, sf))
    assert made == brute(counted(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())) and made


def test_edges_and_empty_tables(spark):
    assert got(spelling.group_variants(edges(spark))) == brute(counted([r[:2] for r in edge_rows()]))
    assert got(spelling.group_variants(empty(spark))) == []
    assert got(spelling.group_variants(edges(spark).withColumn("text", F.lit(None).cast("string")))) == []


def test_each_pair_once_from_either_end(spark):
    words = ["abcdefg", "abcdefgh", "bbcdefg", "abcxefg", "abcdeeg", "abcdefgg", "aabcdefg", "abccdefg", "zzzzzzz"]
    made = spelling.near_words(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")).collect()
    assert {r.word: r.n_near for r in made} == {w: sum(one_edit(w, v) for v in words) for w in words}


def test_long_runs(spark):
    rows = [(1, "a" * 50_000), (2, "a" * 50_000), (3, "a" * 49_999 + " " + "a" * 49_999)]
    assert len(spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 2
