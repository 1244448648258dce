import random

import numpy as np
import pyarrow as pa
import pytest

from framewise.llm import graph, minhash
from tests.llm.common import prose


def brute(rows, n, percent=80):
    sets = [(i, minhash.shingle_set((t or "").encode(), n)) for i, t in rows]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("n", [2, 5])
def test_components_against_all_pairs(spark, n):
    rng = random.Random(n)
    rows = []
    for g in range(6):
        words = prose(g, 120).split()
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(0, 14)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    chain = [f"c{i}" for i in range(140)]
    rows += [(len(rows) + i, " ".join(chain[3 * i : 3 * i + 80])) for i in range(20)]
    shared = prose(99, 12)
    rows += [(len(rows) + i, shared + " " + prose(500 + i, 8)) for i in range(60)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "Solo", "solo", "two words", "TWO WORDS", "two other", " \n"])]
    rng.shuffle(rows)
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=n).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in made) == brute(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in made)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    test_components_against_all_pairs(spark, 2)


def test_a_slot_that_agrees_in_its_bytes_only_is_not_shared():
    """Slot 0 looks shared by the sketch, but only the keys of slot 1 are equal: the pair meets in that bucket alone."""
    words = prose(1, 120)
    texts = [words.encode(), (words + " x").encode(), prose(7, 120).encode()]
    size, _, _, _, sketches = minhash.signatures(texts, 5, 64, 4)
    sketches[1] = sketches[0]
    bands = [[1, 9, *range(100, 130)], [2, 9, *range(200, 230)], [3, 9, *range(300, 330)]]
    names = ["band", "i", "j", "block", "slot", "c", "n", "root", "sketch", "bands", "text"]
    rows = pa.table([pa.array([9] * 3), *[pa.array([0] * 3, pa.int32())] * 3, pa.array([1] * 3, pa.int32()), pa.array([10, 11, 12]), pa.array(size),
                     pa.array([10, 11, 12]), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(texts, pa.binary())], names)
    found = [r for b in minhash._across(5, 80)(iter(rows.to_batches(2))) for r in b.to_pylist()]
    assert found == [{"u": 10, "v": 11}]


def test_agreement_is_unbiased_and_both_ends_count():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(40):
        words = [f"a{k}" for k in rng.integers(0, 10**9, 300)]
        other = words[:250] + [f"b{k}" for k in rng.integers(0, 10**9, 50)]
        a, b = (" ".join(x).encode() for x in (words, other))
        _, _, _, _, s = minhash.signatures([a, b], 1, 64, 4)
        got.append(np.mean(np.frombuffer(s[0], np.uint8) == np.frombuffer(s[1], np.uint8)))
    assert np.mean(got) == pytest.approx(250 / 350, abs=0.02)


def test_one_of_each_group_stays(spark):
    rows = [(3, prose(1, 60), "a"), (2, prose(1, 60) + " x", "b"), (2, prose(1, 60) + " x", "b"), (9, "", "c"), (8, None, "d"), (None, prose(1, 60), "e"), (7, prose(7, 60), "f")]
    made = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert sorted((r.doc_id, r.key) for r in made.collect()) == [(2, "b"), (7, "f"), (8, "d"), (9, "c")]


def test_components_of_a_graph(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(400 - i, 400) for i in range(1, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    root = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    seen = {}
    for u, v in edges:
        for x in (u, v):
            seen.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(seen[u], seen[v])
            if seen[u] != low or seen[v] != low:
                seen[u] = seen[v] = low
                changed = True
    groups = {}
    for x, low in seen.items():
        if x in root:
            groups.setdefault(low, set()).add(root[x])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
