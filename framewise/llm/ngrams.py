"""Quality by hashed word n-grams: logistic regression trained with follow-the-regularised-leader updates, scored as sparse dot products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import map_batches, mix64, utf8
from framewise.llm.words import Words, chunks, hash_words

#: Bounds of the labelled sample that the model is fitted on: texts of each label, and their length. All other steps read all rows.
MOST_TEXTS, MOST_CHARS = 4000, 20_000
#: Buckets of hashed n-grams.
BITS = 20
#: Passes over the sample; rate, its softening, and the two penalties of the updates.
PASSES, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 0.05, 0.05

#: Kinds of bytes: white space, letters and digits (every byte beyond ASCII too), marks.
_KIND = np.full(256, 1, np.uint8)
_KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_AGAIN = np.uint64(0x5EED0FE2D0000002)


def find_tokens(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words, marks being words of one byte, and which are marks. No token crosses texts."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" + bytes(24), np.uint8)
    kind = _KIND[data[: len(data) - 24]]
    new = np.flatnonzero((kind[1:] != 0) & ((kind[1:] == 2) | (kind[:-1] != 1))) + 1
    mark = kind[new] == 2
    stop = np.flatnonzero((kind[:-1] == 1) & (kind[1:] != 1)) + 1  # the ends of the words among them, in order
    end = new + 1
    end[~mark] = stop
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    first = np.searchsorted(new, offset + 1)
    return Words(data, new, end, np.repeat(np.arange(len(texts)), np.diff(first)), first), mark


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values and first places of the n-grams of every text, a row of a sparse matrix each.

    N-grams are single tokens and pairs of neighbours, as they are written; a word that follows itself makes one common pair, whatever the
    word. The value of a bucket is the square root of its share of the text's n-grams, so rows have length 1.
    """
    w, mark = find_tokens(texts)
    h = hash_words(w)
    one = np.arange(len(h))
    inner = np.flatnonzero(w.owner[1:] == w.owner[:-1])
    with np.errstate(over="ignore"):
        two = mix64(h[inner] * np.uint64(0x9E3779B97F4A7C15) + h[inner + 1])
    two[(h[inner] == h[inner + 1]) & ~mark[inner]] = _AGAIN
    every = np.concatenate([h[one], two])
    owner = np.concatenate([w.owner, w.owner[inner]])
    key, n = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | (every >> np.uint64(64 - BITS)), return_counts=True)
    bucket, owner = (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)
    total = np.bincount(owner, n, len(texts))
    return bucket, np.sqrt(n / total[owner]), np.searchsorted(owner, np.arange(len(texts) + 1))


@dataclass
class QualityModel:
    """Weights of the buckets and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of every text: sparse dot products of its row and the weights."""
        bucket, value, first = features(texts)
        part = np.concatenate([[0.0], np.cumsum(self.weights[bucket] * value)])
        z = self.intercept + part[first[1:]] - part[first[:-1]]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(texts: list[bytes], labels: list[int], passes: int = PASSES) -> QualityModel:
    """Follow the regularised leader, a text an update: each bucket has its own rate by the gradients it has seen, and a weight other
    than 0 only where these outweigh the penalty L1. The intercept is not penalised. It starts from the share of label 1."""
    y = np.array(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    intercept, seen = float(np.log(share / (1 - share))), 0.0
    rows = []
    at = 0
    for _, run in chunks(texts):
        bucket, value, first = features(run)
        rows += [(bucket[a:b], value[a:b], y[at + i]) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))]
        at += len(run)
    for _ in range(passes):
        for bucket, value, label in rows:
            p = 1 / (1 + np.exp(-np.clip(intercept + w[bucket] @ value, -50, 50)))
            g = (p - label) * value
            step = (np.sqrt(n[bucket] + g * g) - np.sqrt(n[bucket])) / ALPHA
            z[bucket] += g - step * w[bucket]
            n[bucket] += g * g
            zi = z[bucket]
            w[bucket] = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[bucket])) / ALPHA + L2))
            seen += (p - label) ** 2
            intercept -= ALPHA * (p - label) / (BETA + np.sqrt(seen))
    return QualityModel(w.astype(np.float32), float(intercept))


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> QualityModel:
    """Fits on labelled rows whose crc32(id) mod 3 is not 1: per label the MOST_TEXTS ids that come first by hash, of these the texts of up to
    MOST_CHARS characters. These bounds hold at every size, so the texts may come to the driver. An id labelled both ways counts as 0; of
    several texts of an id the first in code-point order is taken; null texts and ids teach nothing."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    marked = marked.where(_fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = [marked.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TEXTS) for label in (0, 1)]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= MOST_CHARS)
    rows = texts.join(first[0].unionByName(first[1]), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([utf8(r.text) for r in rows], [r.quality for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``. Scores read the whole text alone.

    Null and empty texts have no n-gram: their score is the intercept's. A null id counts as the empty string when rows are held out.
    Repeated rows get the same row. Labels of unknown ids and labels other than 0 and 1 are left out; without any label every score is 0.5. An
    empty table gives an empty result.
    """
    model = learn(docs, labels, doc_id, text, quality)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (_fold(F.col(doc_id)) == 1).alias("held_out"), F.col(text).cast("binary").alias("text"))

    def score(texts: list[bytes | None]) -> tuple:
        return ([float(s) for _, run in chunks(texts) for s in model.scores(run)],)

    return map_batches(rows, score, {"score": "double"}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
