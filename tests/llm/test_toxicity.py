import numpy as np

from framewise.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic == 1 for r in rows])
    rank = s.argsort().argsort()
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.9 and ((s >= 0.5) == y).mean() > 0.94 and (s[~y] >= 0.5).mean() < 0.03
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_one_label_gives_its_share():
    only = toxicity.fit([b"bad text"] * 3, [])
    assert only.score(b"any") > 0.5 and toxicity.fit([], []).score(None) < 1e-9


def test_windows_are_whole_words():
    text = b"Some Words " * 30
    cut = toxicity.windows(text)
    assert b"".join(w[1:] for w in cut).split() == text.lower().split() and all(len(w) >= 64 for w in cut[:-1])
    assert toxicity.windows(None) == toxicity.windows(b" \n") == []
