"""Words of many texts at once: numpy arrays of where each word starts and ends, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

from framewise.llm.common import mix64

CHUNK_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def chunks(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``size`` bytes: (place of the first, texts). Nulls become empty."""
    first, run, total = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or b"")
        total += len(run[-1])
        if total >= size:
            yield first, run
            first, run, total = i + 1, [], 0
    if run:
        yield first, run


@dataclass
class Words:
    """Word i is ``data[start[i]:end[i]]`` of text ``owner[i]``; text t has the words ``first[t]`` to ``first[t + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def find_words(texts: list[bytes]) -> Words:
    """Words between ASCII white space; a word never crosses texts. UTF-8 keeps other characters whole."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" + bytes(24), np.uint8)
    space = _SPACE[data[: len(data) - 24]]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    first = np.searchsorted(start, offset + 1)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def hash_words(w: Words) -> np.ndarray:
    """64 bits per word, the same in every process. Up to 16 bytes are read as two numbers, longer words are hashed one by one."""
    n = w.end - w.start
    at = np.lib.stride_tricks.sliding_window_view(w.data, 8)
    low = at[w.start].view(np.uint64)[:, 0] & _FIRST[np.minimum(n, 8)]
    high = at[np.minimum(w.start + 8, len(w.data) - 8)].view(np.uint64)[:, 0] & _FIRST[np.clip(n - 8, 0, 8)]
    with np.errstate(over="ignore"):
        h = mix64(low * np.uint64(0x9E3779B97F4A7C15) + mix64(high + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    for i in np.flatnonzero(n > 16):
        h[i] = xxhash.xxh3_64_intdigest(w.data[w.start[i] : w.end[i]].tobytes())
    return h


def hash_shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, text by text, and where each text's begin. A text of fewer words is one shingle."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], made)
    last = np.repeat(first[1:], made)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    with np.errstate(over="ignore"):
        for i in range(n):
            inside = at + i < last
            out = np.where(inside, mix64(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + i] + np.uint64(1)), out)
    return out, begin
