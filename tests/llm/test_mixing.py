import random

import pytest

from framewise.llm import mixing


def by_resharing(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """The rule as it is told: share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += give[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 400), ("b", 3), ("ä", 60), (None, 30), ("z", 0), ("hot", 900), ("Z", 5)):
        rows += [(len(rows) + i, " ".join("w" * rng.randint(1, 40)), s) for i in range(n)]
    rows += [(-1, None, "z"), (-2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mixed_sizes(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in made:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = by_resharing(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= 40
    again = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in made}
    n = {}
    for r in mixing.mixed_documents(docs).collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert all(n.get(r.doc_id, 0) * r.size == r.taken for r in made)
