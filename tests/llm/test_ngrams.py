import random
import zlib
from collections import Counter

import numpy as np
import pytest

from framewise.llm import ngrams
from tests.llm.common import edges, empty, prose


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = ngrams.score_quality(docs, labels)
    assert rows.count() == docs.count()
    rows = rows.where("held_out").join(labels, "doc_id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality == 1 for r in rows])
    rank = s.argsort().argsort()
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.99 and (s[y] >= 0.5).mean() > 0.98 and (s[~y] < 0.5).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in rows) and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_tokens_and_pairs_against_plain_version():
    texts = [b"", b" \n", "Été (a,b)!! x x x".encode(), b"one", b"a  b\ta b", b"!!!", "日本 a-b".encode()]
    w, mark = ngrams.find_tokens(texts)
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    def tokens(t):
        out = []
        for word in t.decode().split():
            run = ""
            for c in word:
                if c in marks:
                    out += [run, c] if run else [c]
                    run = ""
                else:
                    run += c
            out += [run] if run else []
        return out

    want = [tokens(t) for t in texts]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == sum(want, [])
    assert mark.tolist() == [t in marks for t in sum(want, [])]
    bucket, value, first = ngrams.features(texts)
    for k, ts in enumerate(want):
        grams = Counter(ts)
        for a, b in zip(ts, ts[1:], strict=False):
            grams["again" if a == b and a not in marks else (a, b)] += 1
        part = value[first[k] : first[k + 1]]
        assert len(set(bucket[first[k] : first[k + 1]].tolist())) == len(part) == len(grams)
        assert np.allclose(np.sort(part), np.sort(np.sqrt(np.array(list(grams.values()), float) / max(1, sum(grams.values())))))


def test_updates_against_a_loop_over_buckets():
    rng = random.Random(4)
    texts = [(prose(i, 12) + rng.choice([" !!", "", " ##"])).encode() for i in range(60)]
    labels = [int(not t.endswith(b"#")) for t in texts]
    model = ngrams.fit(texts, labels, passes=2)
    z, n, share = Counter(), Counter(), (sum(labels) + 0.5) / (len(labels) + 1)
    b, seen = np.log(share / (1 - share)), 0.0

    def weight(k):
        if abs(z[k]) <= ngrams.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * ngrams.L1) / ((ngrams.BETA + n[k] ** 0.5) / ngrams.ALPHA + ngrams.L2)

    for _ in range(2):
        for t, y in zip(texts, labels, strict=True):
            bucket, value, _ = ngrams.features([t])
            row = list(zip(bucket.tolist(), value.tolist(), strict=True))
            p = 1 / (1 + np.exp(-(b + sum(weight(k) * x for k, x in row))))
            for k, x in row:
                g = (p - y) * x
                w, s = weight(k), ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / ngrams.ALPHA
                z[k] += g - s * w
                n[k] += g * g
            seen += (p - y) ** 2
            b -= ngrams.ALPHA * (p - y) / (ngrams.BETA + seen**0.5)
    assert model.intercept == pytest.approx(b, abs=1e-6)
    got = {int(k): float(model.weights[k]) for k in np.flatnonzero(model.weights)}
    want = {k: weight(k) for k in z if weight(k)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got)
    for t, s in zip(texts, model.scores(texts), strict=True):
        bucket, value, _ = ngrams.features([t])
        assert s == pytest.approx(1 / (1 + np.exp(-(model.intercept + model.weights[bucket] @ value))), abs=1e-9)


def test_no_labels_and_odd_labels(spark):
    labels = spark.createDataFrame([(1, None), (99, 1), (None, 0), (2, 7)], "doc_id long, quality int")
    made = ngrams.score_quality(edges(spark), labels).collect()
    assert {r.score for r in made} == {0.5} and ngrams.score_quality(empty(spark), labels).collect() == []


def test_repeated_rows_and_batches_score_alike(spark):
    labels = edges(spark).selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    made = ngrams.score_quality(edges(spark).repartition(7), labels).collect()
    assert len({(r.score, r.predicted) for r in made if r.doc_id == 2}) == 1
    again = ngrams.score_quality(edges(spark).coalesce(1), labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 12)) for r in made) == sorted((str(r.doc_id), round(r.score, 12)) for r in again)
