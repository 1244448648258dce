"""Toxicity by compression distance: windows that a dictionary of toxic text shortens more than one of ordinary text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import map_batches, mix64
from framewise.llm.words import Words, find_words, hash_words

#: Bounds of the labelled sample that the model is fitted on: texts of each label, and their length. All other steps read all rows.
MOST_TEXTS, MOST_CHARS = {1: 2000, 0: 4000}, 20_000
WINDOW = 64
#: Bytes of the two dictionaries' contents.
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 8_192
FEATURES = 7
#: Lengths in bytes of beginnings of words that are tried beside whole words.
STEMS = (4, 5, 6, 8)


def windows(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of whole words of at least WINDOW bytes (the last may be shorter), each between two spaces."""
    out, run, n = [], [], 0
    for w in (text or b"").lower().split():
        run.append(w)
        n += len(w) + 1
        if n >= WINDOW:
            out.append(b" " + b" ".join(run) + b" ")
            run, n = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters.from_level(12, dict_size=65_536, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass
class ToxicModel:
    """Two dictionary contents and the logistic calibration of what they save: thresholds on savings with fitted weights."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    _pair: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "_pair": None}

    def features(self, text: bytes | None) -> np.ndarray:
        """Largest saving of a window, how many windows save 2, 3 and 4 bytes, their shares, and the log of the number of windows.

        Both compressors hold the ordinary content; one has the toxic content before it. So ordinary text costs the same in
        both, and a saving comes from toxic strings."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        plain, toxic = self._pair
        cut = windows(text) if self.toxic else []
        saved = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in cut] or [0])
        n = len(saved)
        return np.array([min(10, saved.max()), *(min(6, (saved >= k).sum()) for k in (2, 3, 4)), *(min(1.0, 10 * (saved >= k).sum() / n) for k in (2, 3)), np.log1p(n)], float)

    def score(self, text: bytes | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Words and beginnings of words that stand in many different places of toxic texts and hardly any of ordinary ones, the
    commonest last, nearest to the ordinary content. A place is a word with both its neighbours, counted once, so that copies of a text weigh no more
    than the text.
    """
    w = find_words([t.lower() for t in [*toxic, *ordinary]])
    if not len(w.start):
        return b""
    h = hash_words(w)
    bad = w.owner < len(toxic)
    around = mix64(np.concatenate([[np.uint64(0)], h[:-1]]) + mix64(np.concatenate([h[1:], [np.uint64(0)]])))
    least, found = max(3, 0.01 * len(toxic)), []
    for size in (*STEMS, 0):
        end = np.minimum(w.end, w.start + size) if size else w.end
        some = np.flatnonzero(w.end - w.start > size)
        key = hash_words(Words(w.data, w.start[some], end[some], w.owner[some], w.first))
        place = mix64(key + mix64(around[some] + h[some]))
        order = np.lexsort((place, key))
        new = np.ones(len(order), bool)
        new[1:] = place[order[1:]] != place[order[:-1]]
        order = order[new]
        kinds, at, inverse = np.unique(key[order], return_index=True, return_inverse=True)
        n_bad, n_good = np.bincount(inverse, bad[some][order]), np.bincount(inverse, ~bad[some][order])
        share_bad, share_good = n_bad / max(1, bad.sum()), (n_good + 0.5) / max(1, (~bad).sum())
        for k in np.flatnonzero((n_bad >= least) & (share_bad > 20 * share_good)):
            i = some[order[at[k]]]
            found.append((-int(n_bad[k]), w.start[i] - end[i], b" " + w.data[w.start[i] : end[i]].tobytes()))
    text = b" "
    for _, _, word in sorted(found):
        if len(text) + len(word) <= TOXIC_BYTES and word not in text:
            text = word + text
    return text if found else b""


def ordinary_content(texts: list[bytes], seed: int = 0) -> bytes:
    every = [w for t in texts for w in windows(t)]
    some = [every[i] for i in np.random.default_rng(seed).permutation(len(every))[:40_000]]
    try:
        return zstd.train_dictionary(ORDINARY_BYTES, some).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself
        return b"".join(some)[:ORDINARY_BYTES]


def fit(toxic: list[bytes], ordinary: list[bytes]) -> ToxicModel:
    """Dictionaries from two thirds of the texts, calibration on the rest, both labels alike. Without either label, or with too few
    texts to hold any back, the score of every text is the share of toxic ones."""
    n = len(toxic) + len(ordinary)
    share = (len(toxic) + 0.5) / (n + 1) if n else 0.0
    flat = ToxicModel(b"", b"", (float(np.log(share / (1 - share))) if n else -50.0, *[0.0] * FEATURES))
    cut = 2 * len(toxic) // 3, 2 * len(ordinary) // 3
    if not all(cut) or cut[0] == len(toxic) or cut[1] == len(ordinary):
        return flat
    model = ToxicModel(ordinary_content(ordinary[: cut[1]]), toxic_words(toxic[: cut[0]], ordinary[: cut[1]]), (0.0,) * (FEATURES + 1))
    rest = [*toxic[cut[0] :], *ordinary[cut[1] :]]
    x = np.array([(1.0, *model.features(t)) for t in rest])
    y = np.array([1.0] * (len(toxic) - cut[0]) + [0.0] * (len(ordinary) - cut[1]))
    w = np.zeros(FEATURES + 1)
    ridge = np.diag([1e-3, *[0.1] * FEATURES])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return ToxicModel(model.ordinary, model.toxic, tuple(map(float, w)))


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicModel:
    """Fits on labelled rows whose crc32(id) mod 5 is not 0: per label the MOST_TEXTS ids that come first by hash, of these the texts of
    up to MOST_CHARS characters. The ids are few enough to be sent to every task; the texts come to the driver."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.where(_fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label, most in MOST_TEXTS.items():
        some = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= MOST_CHARS)
            .join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", F.col("text").cast("binary").alias("text")).collect())
    rows.sort(key=lambda r: hash_order(r.doc_id))
    return fit([bytes(r.text) for r in rows if r.toxic == 1], [bytes(r.text) for r in rows if r.toxic == 0])


def hash_order(doc_id: object) -> tuple[int, str]:
    import zlib

    return zlib.crc32(b"order" + str(doc_id).encode()), str(doc_id)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``. Scores read the text alone.

    Null and empty texts have no window and get the calibrated score of one; a null id counts as the empty string when rows are held
    out. Repeated rows get the same row. Labels of unknown ids and labels other than 0 and 1 are left out. An empty table
    gives an empty result.
    """
    model = learn(docs, labels, doc_id, text, toxic)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (_fold(F.col(doc_id)) == 0).alias("held_out"), F.col(text).cast("binary").alias("text"))
    scored = map_batches(rows, lambda texts: ([model.score(t) for t in texts],), {"score": "double"})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
