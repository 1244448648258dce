import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import attention as at
from tests.llm.common import edge_rows, edges


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    voc = at.Vocabulary.of(rng.integers(0, 50, 400))
    voc.smooth(rng.random((at.HEAD + at.REST + 1, at.HEAD + 1)))
    w = {n: (a + rng.standard_normal(a.shape) * 0.1).astype(np.float64) for n, a in at.initial().items()}
    return voc, w, rng


def test_gradient(small):
    voc, w, rng = small
    ids = rng.integers(0, 400, 90)
    x, target, _ = at.windows(ids, np.array([40, 1, 49]), voc)
    _, g = at.gradient(w, x, target, voc.bigram)
    for n, shape in at.SHAPES.items():
        i = (int(x[0, -1]), 3) if n == "e" else tuple(int(rng.integers(0, s)) for s in shape)
        keep = w[n][i]
        up, down = (w[n].__setitem__(i, keep + d) or at.gradient(w, x, target, voc.bigram)[0] for d in (1e-4, -1e-4))
        w[n][i] = keep
        assert (up - down) / 2e-4 == pytest.approx(g[n][i], rel=0.05, abs=2e-5)


def test_every_subword_is_scored_once_and_sums_to_one(small):
    voc, w, rng = small
    counts = np.array([1, 16, 17, 100])
    _, target, owner = at.windows(rng.integers(0, 400, counts.sum()), counts, voc)
    assert np.bincount(owner, (target >= 0).sum(1)).tolist() == counts.tolist()
    history = rng.integers(0, 400, 20)
    total = 0.0
    for nxt in range(400):
        ids = np.append(history, nxt)
        total += math.exp(at.log_probabilities(w, voc, ids, np.array([21]))[-1])
    assert total == pytest.approx(1, abs=1e-3)


def test_base_columns_against_plain_counts(spark):
    made = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in at.score_documents(edges(spark)).collect()}
    texts = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in edge_rows()]
    c = collections.Counter()
    for i, ws in texts:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(ws)
    n, v = sum(c.values()), len(c)
    for i, ws in texts:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws)
        r = made[(i, len(ws), round(base, 6))]
        assert r.n_known == sum(c[x] > 0 for x in ws) and r.train_tokens == n and r.score < 0


def test_rare_words_are_joined(spark, monkeypatch):
    want = sorted((r.doc_id or 0, r.n_known, round(r.base_score, 6)) for r in at.score_documents(edges(spark)).collect())
    monkeypatch.setattr(at, "HELD", 3)
    assert sorted((r.doc_id or 0, r.n_known, round(r.base_score, 6)) for r in at.score_documents(edges(spark)).collect()) == want


def test_score_does_not_depend_on_which_words_are_held(spark, monkeypatch):
    rows = lambda: sorted((r.doc_id or 0, r.n_known, r.n_tokens, r.score) for r in at.score_documents(edges(spark)).collect())
    want = rows()
    monkeypatch.setattr(at, "HELD", 3)
    for a, b in zip(rows(), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-6)


def test_every_subword_of_every_training_text_is_learned_from(spark, monkeypatch):
    texts = [" ".join(f"w{k % 7} stone{k % 11}" for k in range(n)) for n in (300, 90, 5)] + ["", None]
    model = at.PieceModel.load(at.MODEL)
    rows = spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in enumerate(texts)], "key long, text binary")
    ids, counts, _ = at.subwords([(t or "").encode() for t in texts], at.Encoder(model))
    seen = {}
    of, smooth = at.Vocabulary.of, at.Vocabulary.smooth
    monkeypatch.setattr(at.Vocabulary, "of", staticmethod(lambda c: seen.setdefault("voc", (of(c), c.copy()))[0]))
    monkeypatch.setattr(at.Vocabulary, "smooth", lambda self, p: (seen.setdefault("pairs", p.copy()), smooth(self, p)))
    at.learn(at.encoded(rows.repartition(3), model), model)
    voc, got = seen["voc"]
    assert got.tolist() == np.bincount(ids, minlength=len(model.texts) + 1).tolist()
    assert seen["pairs"].sum() == len(ids)
    assert seen["pairs"][voc.start].sum() == seen["pairs"][:, voc.out[-1]].sum() == len(texts)
    assert at.train(at.packed(at.initial()), voc, iter([(ids, counts)]), 0.004)[1] == sum(-(-c // at.STEP) for c in counts.tolist())


def test_layout_of_the_table_does_not_matter(spark, monkeypatch):
    """The same documents in 1, 4 and 32 partitions, dealt to several shards, give the same scores."""
    monkeypatch.setattr(at, "SHARD", 1 << 12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = lambda n: sorted((r.doc_id, r.score, r.base_score) for r in at.score_documents(docs.repartition(n) if n > 1 else docs.coalesce(1)).collect())
    want = rows(1)
    for n in (4, 32):
        for a, b in zip(rows(n), want, strict=True):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9) and a[2] == pytest.approx(b[2], rel=1e-9)


def test_score_against_one_subword_at_a_time(spark):
    """A plain scorer that sees all subwords before each one in a window of its own, next to the batched windows."""
    model = at.PieceModel.load(at.MODEL)
    docs = spark.createDataFrame([(i, f"stone river {'cloud ' * (i % 5)}ember {i}") for i in range(40)], "doc_id long, text string")
    kept = {}
    learn = at.learn
    at.learn = lambda *a: kept.setdefault("made", learn(*a))
    try:
        made = {r.doc_id: r for r in at.score_documents(docs).collect()}
    finally:
        at.learn = learn
    flat, voc = kept["made"]
    w, encoder = at.unpacked(flat), at.Encoder(model)
    texts = {r.doc_id: r.text.lower().encode() for r in docs.collect()}
    c = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*t.split(), None])
    below = math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    for i in (0, 7, 23):
        ids, counts, per_word = at.subwords([texts[i]], encoder)
        logs = []
        for k in range(counts[0]):
            lead = k // at.STEP * at.STEP  # windows score STEP places and show SPAN
            first = max(0, lead - (at.SPAN - at.STEP))
            seen = np.full(at.SPAN, at.PAD)
            for j in range(first, k + 1):
                seen[at.SPAN - at.STEP + j - lead] = voc.start if j == 0 else voc.seen[ids[j - 1]]
            p, total, _ = at.forward(w, seen[None], voc.bigram, at.STEP)
            logs.append(float(np.log(p[0, k - lead, voc.out[ids[k]]] / total[0, k - lead] + 1e-30)) + float(voc.share[ids[k]]))
        ends = np.cumsum(per_word)
        words = [*texts[i].split(), None]
        total = sum(math.log10(at.SHARE * math.exp(sum(logs[b - n : b])) + (1 - at.SHARE) * (c[x] + 0.1) / 10**below) for x, b, n in zip(words, ends, per_word, strict=True))
        assert made[i].score == pytest.approx(total, rel=1e-5)


def test_a_task_trains_on_one_shard(spark):
    """By hash, 70 shards went to 41 of 70 tasks, up to 5 to one."""
    rows = spark.range(4000).selectExpr("id AS key", "id % 70 AS shard", "CAST('ab' AS binary) AS ids")
    per_task = at.apart(rows, 70).select("shard", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().collect()
    assert len(per_task) == 70 and all(r["count"] == 1 for r in per_task)


def test_numbers_of_a_text_do_not_depend_on_its_place(small):
    voc, w, rng = small
    w = {n: a.astype(np.float32) for n, a in w.items()}
    texts = [rng.integers(0, 400, n) for n in (1, 15, 16, 17, 300, 2, 1100, 40)]
    alone = [at.log_probabilities(w, voc, t, np.array([len(t)])) for t in texts]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(texts))
        counts = np.array([len(texts[i]) for i in order])
        made = at.log_probabilities(w, voc, np.concatenate([texts[i] for i in order]), counts)
        for i, got in zip(order, np.split(made, np.cumsum(counts)[:-1]), strict=True):
            assert np.array_equal(got, alone[i])


def test_weights_beyond_single_precision(small):
    voc, w, rng = small
    x, _, _ = at.windows(rng.integers(0, 400, 40), np.array([40]), voc)
    for name, factor in (("u", 400), ("q", 4000)):
        big = {n: a * (factor if n == name else 1) for n, a in w.items()}
        p, total, _ = at.forward({n: a.astype(np.float32) for n, a in big.items()}, x, voc.bigram)
        exact, sums, _ = at.forward(big, x, voc.bigram)
        assert np.isfinite(p).all() and np.isfinite(total).all()
        assert np.abs(p / total[..., None] - exact / sums[..., None])[0].max() < 0.02


def test_subwords_are_those_of_the_joined_text():
    """Words encoded once by hash, next to the whole text given to the encoder."""
    model = at.PieceModel.load(at.MODEL)
    texts = [b"", b"  Stone\triver  stone\n", "É a\u2581b \u2581 \u2581\u2581c".encode(), b"\xff\xfe bad \xe2\x82 x", b"\x00 \x00\x00 A\x1cB", b"y" * 100, b"stone " * 50]
    for prefix in (True, False):
        model.prefix = prefix
        plain, hashed = at.Encoder(model), at.Encoder(model)
        for _ in range(2):
            ids, counts, per_word = at.subwords(texts, hashed)
            for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                want = plain.encode([b" ".join(t.lower().split()).decode("utf-8", "replace")])[0]
                assert got.tolist() == [*want.tolist(), len(model.texts)]
            assert per_word.sum() == len(ids) and len(per_word) == sum(len(t.split()) + 1 for t in texts)
