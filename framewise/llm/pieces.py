"""SentencePiece encoding by batched Viterbi in numpy, and exact decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a U+2581 that is in the text itself, so that it isn't taken for a space. No valid text has a lone surrogate.
LITERAL = "\ud800"
#: Hash base; a prefix of a word hashes to sum(code * BASE ** k).
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
#: A merge-based model scores a piece by its rank r, not by a log-probability. Its ranks are read by the Zipf-Mandelbrot law,
#: log p = -log(r + SHIFT), which the best path needs. A unigram model's scores are taken as they are.
SHIFT = 100.0
#: A unit longer than this is first cut where no piece crosses.
LONG = 48
#: Code points encoded in one batch.
AT_ONCE = 100_000
#: Units held in memory with their pieces; beyond this the store starts anew.
HELD = 200_000


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(L, n) code points, a word a column, to (L + 1, n) hashes of the first 0..L of them."""
    out = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[0]):
            out[i + 1] = out[i] * BASE + codes[i] + np.uint64(1)
    return out


@dataclass
class PieceModel:
    """Pieces by length with sorted hash keys, their scores, and the bytes of each id. As large as the vocabulary."""

    keys: list[np.ndarray]
    ids: list[np.ndarray]
    scores: np.ndarray
    filter: np.ndarray
    powers: np.ndarray
    unknown: float
    byte_base: int
    texts: list[bytes]
    solo: str
    prefix: bool

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalization and byte fallback are supported: others can't be decoded exactly")
        sp = SentencePieceProcessor(model_proto=proto.SerializeToString())
        normal = [(p.piece, i) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("a piece has a space after another character")
        longest = max(len(p) for p, _ in normal)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.full(longest + 1, BASE)) * np.uint64(pow(int(BASE), -1, 1 << 64))
        keys, ids, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], np.zeros(1 << FILTER_BITS, bool)
        for n in range(1, longest + 1):
            own = [(p, i) for p, i in normal if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p, _ in own], np.uint64).reshape(len(own), n)
            h = _prefix_hashes(codes.T)[n]
            order = np.argsort(h)
            keys.append(h[order])
            ids.append(np.array([i for _, i in own], np.int32)[order])
            seen[h >> np.uint64(64 - FILTER_BITS)] = True
        scores = np.array([p.score for p in proto.pieces], float)
        if proto.trainer_spec.model_type == 2:
            scores = -np.log(np.maximum(-scores, 0) + SHIFT)
        texts = [b"" if p.type in (2, 3) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        crossing = {c for p, _ in normal if len(p) > 1 for c in p}
        solo = "".join(c for c in "\n\t\r" if c not in crossing)
        return PieceModel(keys, ids, scores, seen, powers, min(scores[i] for _, i in normal) - 10, sp.piece_to_id("<0x00>"), texts, solo, spec.add_dummy_prefix)

    def units(self, text: str) -> list[str]:
        """The text cut where no piece can cross: before a space that follows something else, and around the solo characters."""
        if not text:
            return []
        marked = text.replace(SPACE, LITERAL).replace(" ", SPACE)
        s = re.escape(self.solo)
        return re.findall(f"[{s}]|{SPACE}*[^{SPACE}{s}]+|{SPACE}+" if s else f"{SPACE}*[^{SPACE}]+|{SPACE}+", (SPACE if self.prefix else "") + marked)

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """[length] -> (L - length + 1, n) ids of the pieces that start there, -1 for none, of (L, n) codes. Hashes of substrings probe the sorted keys."""
        width, n = codes.shape
        h = _prefix_hashes(codes)
        out = [np.zeros((0, n), np.int32)]
        for size in range(1, min(width, len(self.keys) - 1) + 1):
            with np.errstate(over="ignore"):
                sub = h[size:] - h[:-size] * self.powers[size]
            found = np.full(sub.shape, -1, np.int32)
            at = np.flatnonzero(self.filter[sub >> np.uint64(64 - FILTER_BITS)])
            if len(at) and len(self.keys[size]):
                probe = sub.reshape(-1)[at]
                place = np.minimum(np.searchsorted(self.keys[size], probe), len(self.keys[size]) - 1)
                hit = self.keys[size][place] == probe
                found.reshape(-1)[at[hit]] = self.ids[size][place[hit]]
            out.append(found)
        return out

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best-scoring pieces of the n words of (L, n) codes: (ids word after word, how many each has).

        All words advance together, end by end; a place of all words is one row in memory. Among equal sums the longest last piece stays.
        A character without a piece costs ``unknown`` and is given as -1 - code point.
        """
        width, n = codes.shape
        found = self.matches(codes)
        if n == 1 and width > LONG:
            return self._single(codes[:, 0], found)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.ones((width + 1, n), np.int16)
        met = [(m >= 0).any(1).tolist() for m in found]
        for end in range(1, width + 1):
            for size in range(min(end, len(found) - 1), 0, -1):
                if size > 1 and not met[size][end - size]:
                    continue
                ids = found[size][end - size]
                total = best[end - size] + np.where(ids >= 0, self.scores[ids], -np.inf if size > 1 else self.unknown)
                better = total > best[end]
                np.copyto(best[end], total, where=better)
                np.copyto(back[end], size, where=better)
        out = np.zeros((n, width), np.int32)
        used = np.zeros((n, width), bool)
        at, row = np.full(n, width), np.arange(n)
        while len(row):
            size = back[at, row].astype(int)
            ids = np.zeros(len(row), np.int32)
            for k in np.unique(size):
                pick = size == k
                ids[pick] = found[k][at[pick] - k, row[pick]]
            lone = ids < 0
            ids[lone] = -1 - codes[at[lone] - 1, row[lone]].astype(np.int32)
            at = at - size
            out[row, at], used[row, at] = ids, True
            row, at = row[at > 0], at[at > 0]
        return out[used], used.sum(1)

    def _single(self, codes: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`viterbi` of one long word, where a batch of one would be slow."""
        ids = [m[:, 0].tolist() for m in found]
        worth, best, back = self.scores.tolist(), [0.0], [0]
        for end in range(1, len(codes) + 1):
            top, last = -np.inf, 1
            for size in range(min(end, len(ids) - 1), 0, -1):
                i = ids[size][end - size]
                if i >= 0 or size == 1:
                    total = best[end - size] + (worth[i] if i >= 0 else self.unknown)
                    if total > top:
                        top, last = total, size
            best.append(top)
            back.append(last)
        out, at = [], len(codes)
        while at:
            size = back[at]
            at -= size
            i = ids[size][at]
            out.append(i if i >= 0 else -1 - int(codes[at]))
        return np.array(out[::-1], np.int32), np.array([len(out)])

    def _cut(self, unit: str) -> list[str]:
        """A long unit, cut at the places that no piece crosses."""
        codes = np.array([[ord(c)] for c in unit], np.uint64)
        crossed = np.zeros(len(unit) + 1, np.int64)
        for size, m in enumerate(self.matches(codes)):
            if size > 1:
                start = np.flatnonzero(m[:, 0] >= 0)
                np.add.at(crossed, start + 1, 1)
                np.add.at(crossed, start + size, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1), len(unit)]
        return [unit[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each); words of one length go through :meth:`viterbi` in one batch.
        Characters without a piece become bytes."""
        parts = [self._cut(u) if len(u) > LONG else (u,) for u in units]
        flat = [p for ps in parts for p in ps]
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        size, runs = np.zeros(len(flat), np.int64), []
        order = np.argsort(lengths, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(lengths[order])) + 1, [len(order)]])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            width = int(lengths[order[lo]]) if hi > lo else 0
            step = max(1, AT_ONCE // max(1, width))
            for a in range(lo, hi, step):
                some = order[a : min(hi, a + step)]
                codes = np.frombuffer("".join([flat[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), width).T.astype(np.uint64, order="C")
                ids, counts = self.viterbi(codes)
                if ids.min() < 0:
                    ids, counts = self._bytes(ids, counts)
                size[some] = counts
                runs.append((some, ids))
        begin = np.cumsum(size) - size
        out = np.zeros(size.sum(), np.int32)
        for some, ids in runs:
            n = size[some]
            out[np.arange(len(ids)) + np.repeat(begin[some] - (np.cumsum(n) - n), n)] = ids
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        return out, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])])

    def _bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (-1 - code point) become the ids of their bytes."""
        made = {}
        for i in np.unique(ids[ids < 0]).tolist():
            char = chr(-1 - i)
            made[i] = [self.byte_base + b for b in (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass")]
        wide = np.ones(len(ids), np.int64)
        for i, own in made.items():
            wide[ids == i] = len(own)
        begin = np.cumsum(wide) - wide
        out = np.repeat(ids, wide)
        for i, own in made.items():
            for k, byte in enumerate(own):
                out[begin[ids == i] + k] = byte
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, wide, len(counts)).astype(np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts; every distinct unit is encoded once while it is held."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes, self.place_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _store(self, units: list[str]) -> None:
        ids, size = self.model.encode_units(units)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units at these places one after another, number of ids of each)."""
        n = self.size[at]
        stop = np.cumsum(n)
        index = np.arange(stop[-1] if len(n) else 0) + np.repeat(self.begin[at] - (stop - n), n)
        return self.flat[index], n

    def encode_hashed(self, h: np.ndarray, units: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each) of units given by a 64-bit hash; ``units`` gives those at some
        places, asked for where no unit with their hash is held."""
        if len(self.hashes) > HELD:
            self._clear()
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, kinds)
        known = np.zeros(len(kinds), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == kinds[inside]
        new = np.flatnonzero(~known)
        if len(new):
            place = len(self.size) + np.arange(len(new))
            self._store(units(first[new]))
            self.hashes, self.place_of = np.insert(self.hashes, at[new], kinds[new]), np.insert(self.place_of, at[new], place)
            at = np.searchsorted(self.hashes, kinds)
        return self._gathered(self.place_of[at][back])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); nulls count as empty."""
        return self.encode_parts(texts)[:2]

    def encode_parts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`encode`, and the number of ids of every unit: where words have one space between them, of every word."""
        if len(self.place) > HELD:
            self._clear()
        cut = [self.model.units(t or "") for t in texts]
        place, at, new = self.place, [], []
        for us in cut:
            for u in us:
                k = place.get(u)
                if k is None:
                    k = place[u] = len(place)
                    new.append(u)
                at.append(k)
        if new:
            self._store(new)
        ids, n = self._gathered(np.array(at, np.int64))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[ends]), n


def encode_documents(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``: the best-scoring pieces of every whole text.

    Null and empty texts have no ids. ``check`` names a further column with the lowercase hex SHA-256 of the text decoded from
    the ids. Repeated rows get the same ids; an empty table gives an empty result. Each task holds at most HELD distinct units.
    """
    pieces = PieceModel.load(model)
    state: dict[str, Encoder] = {}

    def run(texts: list[str | None]) -> tuple:
        import hashlib

        encoder = state.setdefault("encoder", Encoder(pieces))
        parts, sums = [], []
        for a in range(0, len(texts), 500):
            got, n = encoder.encode(texts[a : a + 500])
            parts.append((got, n))
            if check:
                sums += [hashlib.sha256(pieces.decode(x.tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in np.split(got, np.cumsum(n)[:-1])]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))]).astype(np.int32) if parts else np.zeros(1, np.int32)
        flat = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return (lists, sums) if check else (lists,)

    return map_batches(docs, run, {ids: "array<int>"} | ({check: "string"} if check else {}), reads=(text,))


def decode_documents(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the decoded ``text`` in place of ``ids``; null ids give an empty text."""
    pieces = PieceModel.load(model)
    return map_batches(rows, lambda lists: ([pieces.decode(x or ()) for x in lists],), {text: "string"}, reads=(ids,))


def encoded_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, n_chars, ids, n_ids, decoded_sha256`` of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"), F.col(text).alias("text"))
    return encode_documents(rows, model=model, check="decoded_sha256").withColumn("n_ids", F.size("ids").cast("bigint"))
