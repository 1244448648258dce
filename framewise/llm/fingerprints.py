"""Document fingerprints by consistent weighted sampling, and how they stand an edit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import ARROW, mix64, row_key, stage, utf8
from framewise.llm.words import chunks, find_words, hash_words

SAMPLES = 64
#: Bytes of text sampled together; words they share are drawn for once.
BATCH_BYTES = 4_000_000
NONE = np.uint16(0)


def draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """(terms, samples) float32: log of the arrival value of each weighted term under each sample.

    Per term and sample r and c come from Gamma(2, 1) and b from U(0, 1), all fixed by the term's hash: t = floor(ln w / r + b)
    is a level of the weight, and ln c - r (t - b + 1) its value. The least value of a text is reached at the same term and level
    as another's with a probability of sum(min weights) / sum(max weights), the generalised Jaccard similarity.
    """
    k = mix64(np.arange(1, samples + 1, dtype=np.uint64))
    one = mix64(terms[:, None] + k)
    two = mix64(one ^ np.uint64(0x9E3779B97F4A7C15))
    low, unit = np.uint64((1 << 24) - 1), np.float32(2.0**-24)

    def uniform(bits: np.ndarray) -> np.ndarray:
        return ((bits & low).astype(np.float32) + np.float32(0.5)) * unit

    r = -np.log(uniform(one) * uniform(one >> np.uint64(24)))
    c = -np.log(uniform(two) * uniform(two >> np.uint64(24)))
    b = ((one >> np.uint64(48)) << np.uint64(8) | (two >> np.uint64(56))).astype(np.float32) * unit
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    return np.log(c) - r * (t - b + np.float32(1))


def fingerprints(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) uint16: terms are lower-cased words (A-Z), weighted by how often they occur. A text without words is all 0."""
    out = np.full((len(texts), samples), NONE)
    for first, run in chunks(texts, BATCH_BYTES):
        w = find_words([t.lower() for t in run])
        if not len(w.start):
            continue
        h = hash_words(w)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w.owner[1:] != w.owner[:-1])
        at = np.flatnonzero(new)
        weight = np.diff(np.concatenate([at, [len(h)]]))
        term, owner = h[at], w.owner[at]
        order = np.lexsort((weight, term))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (term[order[1:]] != term[order[:-1]]) | (weight[order[1:]] != weight[order[:-1]])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        lead = order[fresh]
        value = np.empty((len(lead), samples), np.float32)
        for a in range(0, len(lead), 8192):
            value[a : a + 8192] = draws(term[lead[a : a + 8192]], weight[lead[a : a + 8192]], samples)
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        who = owner[begin]
        for a in range(0, len(begin), 64):
            lo, hi = begin[a], begin[a + 64] if a + 64 < len(begin) else len(owner)
            least = np.minimum.reduceat(value[kind[lo:hi]], begin[a : a + 64] - lo, axis=0)
            bits = mix64(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)
            out[first + who[a : a + 64]] = bits.astype(np.uint16)
    return out


def written(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples that agree; an empty fingerprint is like an empty one alone."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_RESULT = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


def _compared(texts: list[str], following: list[str], known: np.ndarray, after: np.ndarray) -> list[list]:
    """The columns of _RESULT; ``known`` and ``after`` are the fingerprints of the texts and of the following ones."""
    other = [utf8(edited(a, b)) for a, b in zip(texts, following, strict=True)]
    sign = fingerprints(other, known.shape[1])
    return [[len(t) for t in texts], [hashlib.sha256(x).hexdigest() for x in other], [written(x) for x in known], [written(x) for x in sign],
            [likeness(a, b) for a, b in zip(known, sign, strict=True)], [likeness(a, b) for a, b in zip(known, after, strict=True)]]


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id`` and _RESULT for every row: the fingerprint of its text, of the text edited with the next row's, and how like they are.

    Next is the row that follows by descending id (nulls last; equal ids by a hash of the row); the first follows the last, and a
    lone row follows itself. Null texts are empty. Rows are dealt out by ranges of id, and each task reads its range in order; only
    the first and the last text of a range wait for the range beside it, two rows a task. An empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, {', '.join(f'{c} {t}' for c, t in _RESULT.items())}, part int, side int, text string"
    names = ["doc_id", *_RESULT, "part", "side", "text"]

    def rows(ids: pa.Array, columns: list, part: int | None, side: int, texts: list) -> pa.RecordBatch:
        n = len(ids)
        made = [pa.array(c if c is not None else [None] * n, ARROW[t]) for c, t in zip(columns, _RESULT.values(), strict=True)]
        return pa.RecordBatch.from_arrays([ids, *made, pa.array([part] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(texts, pa.string())], names)

    blank = [None] * len(_RESULT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            ids, texts = b.column("doc_id"), [t or "" for t in b.column("text").to_pylist()]
            if not texts:
                continue
            if held is None:
                yield rows(ids[:1], blank, part, 0, texts[:1])
            start = 0
            for size in [len(run) for _, run in chunks([utf8(t) for t in texts], BATCH_BYTES)]:
                own, own_ids = texts[start : start + size], ids[start : start + size]
                sign = fingerprints([utf8(t) for t in own], samples)
                if held is not None:
                    own, sign = [held[1], *own], np.concatenate([held[2], sign])
                    own_ids = pa.concat_arrays([held[0], own_ids])
                if len(own) > 1:
                    yield rows(own_ids[:-1], _compared(own[:-1], own[1:], sign[:-1], sign[1:]), None, 2, [None] * (len(own) - 1))
                held, start = (own_ids[-1:], own[-1], sign[-1:]), start + size
        if held is not None:
            yield rows(held[0], blank, part, 1, [held[1]])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        first: str | None = None
        for b in batches:
            for i, (side, t) in enumerate(zip(b.column("side").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if side == 1:
                    held = (b.column("doc_id")[i : i + 1], t)
                else:
                    first = t if first is None else first
                    if held is not None:
                        yield last(held, t)
                        held = None
        if held is not None and first is not None:
            yield last(held, first)

    def last(held: tuple, following: str) -> pa.RecordBatch:
        sign = fingerprints([utf8(held[1]), utf8(following)], samples)
        return rows(held[0], _compared([held[1]], [following], sign[:1], sign[1:]), None, 2, [None])

    order = [F.desc("doc_id"), F.desc("h")]
    ordered = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("h"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    done = stage(ordered.drop("h").mapInArrow(scan, schema), "fingerprints")
    ends = done.where("side < 2").coalesce(1).sortWithinPartitions("part", "side").mapInArrow(joined, schema)
    return done.where("side = 2").unionByName(ends).select("doc_id", *_RESULT)
