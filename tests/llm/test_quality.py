import collections

import duckdb
import numpy as np

from framewise.llm import quality
from tests.llm.common import prose


def plain(text: str) -> tuple:
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    tri = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if tri[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_plain_rules():
    texts = ["", "a", "a b", "a b c", "a b c a b c", "x y z\n\n x y z\nx y z\r\nx y z", "é ü ß k \x0b#*<|>", prose(4, 300) + "\n" + prose(4, 100), "a " * 500]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for t in texts:
        assert quality.counts(t.encode())[:5] == plain(t)
    assert quality.counts(None)[:5] == (0, 0, 0, 0, 0)


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7])
    right = rng.random((20_000, 4)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((20_000, 4)) < 0.8)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns.astype(float), n.astype(float))
    assert np.allclose(model.accuracy, accuracy, atol=0.04) and abs(model.prior - 0.7) < 0.04
    assert ((model.posterior(votes.astype(float)) >= 0.5) == truth).mean() > 0.9


def test_verdicts_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r[-2] == 1]
    bad = [r.kept for r in rows if r[-2] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1
