import collections
import hashlib

import numpy as np
import pytest

from framewise.llm import fingerprints
from tests.llm.common import edge_rows, edges, prose


def similarity(a: str, b: str) -> float:
    x, y = (collections.Counter(t.encode().lower().split()) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_agreement_is_the_generalised_jaccard_similarity():
    pairs = [(prose(i, 200), fingerprints.edited(prose(i, 200), prose(i + 1, 200))) for i in range(60)]
    signs = fingerprints.fingerprints([t.encode() for p in pairs for t in p], 128)
    got = [np.mean(signs[2 * i] == signs[2 * i + 1]) for i in range(len(pairs))]
    assert np.mean(got) == pytest.approx(np.mean([similarity(a, b) for a, b in pairs]), abs=0.02)


def test_next_text_and_edit(spark):
    made = fingerprints.fingerprint_edits(edges(spark).repartition(5)).collect()
    assert len(made) == len(edge_rows())
    rows = sorted(((r[0], r[1] or "") for r in edge_rows() if r[0] is not None and r[0] != 2), reverse=True)
    ids = {r[0]: k for k, r in enumerate(rows)}
    by = {r.doc_id: r for r in made}
    for a in (2**60 + 2, 10, 9, 8, 6, 5, 4):
        text, following = rows[ids[a]][1], rows[ids[a] + 1][1]
        n = len(text) // 3
        want = text[: len(text) - n] + following[:n]
        assert by[a].n_chars == len(text) and by[a].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint == "0" * 256
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in made)


@pytest.mark.parametrize("parts", [1, 3])
def test_first_follows_last_in_any_layout(spark, parts):
    rows = [(i, prose(i, 30 + i)) for i in range(12)]
    made = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    for i, t in rows:
        want = fingerprints.edited(t, rows[i - 1][1])
        assert made[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    (alone,) = fingerprints.fingerprint_edits(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert alone.near_next == 1.0
