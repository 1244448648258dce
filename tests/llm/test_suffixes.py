import random

import numpy as np

from framewise.llm import suffixes


def test_multikey_order_shares_leading_tokens():
    rng = np.random.default_rng(0)
    tokens = [rng.integers(0, 4, 500) for _ in range(3)]
    order, shared = suffixes.multikey_order(tokens)
    rows = [tuple(t[i] for t in tokens) for i in order]
    assert rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], shared[1:], strict=False):
        assert n == next((k for k in range(3) if a[k] != b[k]), 3)


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    long, edge, under = noise(900), noise(420), noise(398)
    texts = [noise(200) + long + noise(100), long[:500] + noise(50), noise(10) + long[300:] + long[300:], long, long, "", noise(399), "a" * 1500, "ab" * 700,
             edge + "x" + edge, under + "1", "2" + under, noise(30) + edge[5:] + noise(3) + edge[:-5], noise(3000)]
    for _ in range(30):
        a, n = rng.randrange(500), rng.randrange(300, 600)
        texts.append(noise(rng.randrange(80)) + long[a : a + n] + noise(rng.randrange(80)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None), (0, texts[0])]
    made = suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = suffixes.brute_force([(t or "").encode() for _, t in rows])
    import hashlib

    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in made)
    assert got == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))
    for r in made:
        spans = [tuple(map(int, x.split(":"))) for x in r.removed.split(",") if x]
        assert len(spans) == r.n_spans and sum(b - a for a, b in spans) == r.n_removed
