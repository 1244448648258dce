import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from framewise.llm import infilling
from tests.llm.common import edge_rows, edges

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The same, a text at a time with a regular expression."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_unit_ends_against_regex():
    rng = random.Random(3)
    signs = ["a", "b", " ", "\n", "\t", "\x0b", "\x0e", "\x08", "\x1f", "!", "é", "日", "🙂", "\u0085", " ", "\x00", "\x7f", "†", "ठ"]
    texts = ["".join(rng.choice(signs) for _ in range(n)) for n in range(60) for _ in range(6)]
    units = infilling.Units.of([t.encode() for t in texts])
    want = [np.cumsum([0, *(len(u.encode()) for u in UNIT.findall(t))]) for t in texts]
    assert units.counts().tolist() == [len(w) - 1 for w in want]
    for k in range(70):
        at = np.minimum(k, units.counts())
        assert units.byte_after(at).tolist() == [w[i] for w, i in zip(want, at, strict=True)]


def test_all_bytes_are_told_apart():
    x = np.arange(256, dtype=np.uint8).repeat(8).view("<u8")
    got = infilling.space_bits(x).view(np.uint8).reshape(256, 8)
    assert (got == np.where(np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), 0x80, 0)[:, None]).all()


def test_rows_against_plain_version_and_back(spark):
    made = infilling.fill_in_middle(edges(spark)).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == order((i, *plain(i, t)) for i, t, *_ in edge_rows())
    assert order((r.doc_id, r.back) for r in made) == order((i, t or "") for i, t, *_ in edge_rows())


def test_texts_that_look_like_marks_come_back(spark):
    texts = ["a <P b <P> c", "<S", "<M <S< P> <<P", "x<", "<P", "S>", " ", "\n\n", "<", "> <P ><", "P> M> S> <M", "é<S é <P"]
    rows = [(i, t) for i in range(40) for t in texts]
    made = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    made = made.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r.doc_id, r.back) for r in made) == sorted(rows) and {r.form for r in made} == {"plain", "psm", "spm"}
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made if r.form != "plain") == sorted(x for i, t in rows for x in [(i, *plain(i, t))] if x[2] != "plain")
