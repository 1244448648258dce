"""Exact repeated substrings: a suffix sort over the places where a repeat can be.

Suffixes are compared over their first WINDOW bytes, read as three tokens (256 + 128 + 16 bytes). Sorting every suffix of the corpus
would move each byte many times over, so anchors say first where it is needed. The anchor of a window is the 128-byte string in
it with the least hash: a function of the window's bytes alone, so equal windows have equal anchors at equal places. Consecutive
windows share an anchor; their joint bytes are its context.

1. Anchors and contexts are counted. An anchor seen once has no repeated window. Where a whole context is seen again, all its
   windows are repeated.
2. What is left are contexts seen once around an anchor seen more often: the ends of repeated passages. All windows of a half of a
   context have the anchor and the bytes on one side of it in common, 264 bytes; halves that share these with no other context
   are done. The others are cut into blocks of 16 windows, which have 384 bytes in common, and blocks are settled like contexts.
3. The suffixes of the blocks that are still open, and those of one copy of every other such block, are range-partitioned by leading tokens at sampled splitters; each
   bucket sorts its suffixes token by token and compares neighbours; the outermost suffixes of the buckets are compared across.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import map_batches, row_key, shared_folder, stage
from framewise.llm.words import chunks

WINDOW, ANCHOR = 400, 128
#: Bytes before the anchor that windows of the left half have in common; (WINDOW - ANCHOR) / 2.
HALF = 136
#: Windows of a block; all of them have WINDOW - BLOCK + 1 bytes in common.
BLOCK = 16
#: Low bits of a packed (hash, place) that hold the place in a chunk.
PLACE_BITS = 30
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray, factor: np.uint64 = _A) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * factor) ^ (a >> np.uint64(29))
        x = (x + b) * _B
        return x ^ (x >> np.uint64(32))


def _ladder(data: np.ndarray, factor: np.uint64 = _A) -> dict[int, np.ndarray]:
    """{size: hash of the size bytes from each place on} for 16, 32, ... 256. ``data`` must have WINDOW bytes after the last place asked for."""
    first = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = _pair(np.ascontiguousarray(first).view(np.uint64)[:, 0], factor, factor)
    out, size = {}, 8
    while size < 256:
        h = _pair(h[: len(h) - size], h[size:], factor)
        size *= 2
        out[size] = h
    return out


def _window(ladder: dict[int, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading token (256 bytes) and the two others (128 + 16 bytes) as one."""
    return ladder[256][at], _pair(ladder[128][at + 256], ladder[16][at + 384])


def _joined(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(run) + bytes(2 * WINDOW), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in run])]).astype(np.int64)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def contexts(texts: list[bytes | None]) -> tuple:
    """Per text lists with a value per anchor: first and last window start, place of the anchor, hashes of the anchor and of the
    context, and of the anchor with HALF bytes before it, and after it."""
    held: list[list[np.ndarray]] = [[] for _ in range(8)]
    for _, run in chunks(texts):
        data, begin = _joined(run)
        ladder = _ladder(data)
        grams = ladder[ANCHOR]
        small = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW - ANCHOR + 1:
            small = np.minimum(small[: len(small) - span], small[span:])
            span *= 2
        rest = WINDOW - ANCHOR + 1 - span
        small = np.minimum(small[: len(small) - rest], small[rest:])
        length = np.diff(begin)
        starts = np.maximum(length - WINDOW + 1, 0)
        at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(begin[:-1], starts)
        owner = np.repeat(np.arange(len(run)), starts)
        anchor = (small[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(at)]])[: len(head)] - 1
        lo, hi, mid = at[head], at[tail], anchor[head]
        (a, b), (x, y) = _window(ladder, lo), _window(ladder, hi)
        shape = ((hi - lo) * WINDOW + (mid - lo)).astype(np.uint64)
        own = owner[head]
        before = np.maximum(mid - HALF, 0)
        left = _pair(_pair(ladder[128][before], ladder[16][before + HALF - 16]), grams[mid])
        right = _pair(grams[mid], _pair(ladder[128][mid + ANCHOR], ladder[16][mid + ANCHOR + HALF - 16]))
        made = (lo - begin[own], hi - begin[own], mid - begin[own], grams[mid].view(np.int64), _pair(_pair(a, b), _pair(_pair(x, y), shape)).view(np.int64),
                left.view(np.int64), right.view(np.int64), np.bincount(own, minlength=len(run)))
        for to, v in zip(held, made, strict=True):
            to.append(v)
    if not held[-1]:
        return tuple([] for _ in range(7))
    n = np.concatenate(held[-1])
    return tuple(_lists(n, np.concatenate(v)) for v in held[:-1])


def blocks(texts: list[bytes | None], ranges: list[list]) -> tuple:
    """Per text lists with a value per block of its ranges: first and last window start, hash of what all windows of the block have in
    common, hash of the block, and whether its context was seen once (1 or 0). Blocks are counted from the anchor."""
    held: list[list[np.ndarray]] = [[] for _ in range(6)]
    for first, run in chunks(texts):
        data, begin = _joined(run)
        ladder = _ladder(data)
        own = [[(r["lo"], r["hi"], r["mid"], r["once"]) for r in ranges[first + i] or []] for i in range(len(run))]
        n_own = np.array([len(o) for o in own])
        lo, hi, mid, once = np.array([x for o in own for x in o], np.int64).reshape(-1, 4).T
        near, far = (mid - hi) // BLOCK, (mid - lo) // BLOCK
        n = far - near + 1
        which = np.repeat(np.arange(len(lo)), n)
        j = near[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.maximum(lo[which], mid[which] - j * BLOCK - BLOCK + 1), np.minimum(hi[which], mid[which] - j * BLOCK)
        base = np.repeat(begin[:-1], n_own)[which]
        core = mid[which] - j * BLOCK + base
        (p, q), (x, y) = _window(ladder, a + base), _window(ladder, b + base)
        shape = ((b - a) * WINDOW + j * BLOCK - (mid[which] - b)).astype(np.uint64)
        per_text = np.bincount(np.repeat(np.repeat(np.arange(len(run)), n_own), n), minlength=len(run))
        for to, v in zip(held, (a, b, _pair(ladder[256][core], ladder[128][core + 256]).view(np.int64), _pair(_pair(p, q), _pair(_pair(x, y), shape)).view(np.int64), once[which], per_text), strict=True):
            to.append(v)
    if not held[-1]:
        return tuple([] for _ in range(5))
    n = np.concatenate(held[-1])
    return tuple(_lists(n, np.concatenate(v)) for v in held[:-1])


def suffixes(texts: list[bytes | None], ranges: list[list]) -> tuple:
    """Per text four lists with a value per suffix to sort: its three tokens (the third a second hash of the whole window, so that
    two windows are one only if 192 bits agree) and its start; ``ranges`` has (first start, last start, seen once) per context.
    Starts of contexts seen once are positive (start + 1), those of others negative."""
    t0, t1, t2, at_, n_ = [], [], [], [], []
    for first, run in chunks(texts):
        data, begin = _joined(run)
        one, two = _ladder(data), _ladder(data, np.uint64(0xA0761D6478BD642F))
        starts, sign, counts = [], [], []
        for i in range(len(run)):
            own = ranges[first + i] or []
            spots = [np.arange(r["lo"], r["hi"] + 1) for r in own]
            counts.append(sum(map(len, spots)))
            starts += [s + begin[i] for s in spots]
            sign += [np.where(r["once"], 1, -1) * (s + 1) for r, s in zip(own, spots, strict=True)]
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        a, b = _window(one, at)
        x, y = _window(two, at)
        t0.append(a.view(np.int64))
        t1.append(b.view(np.int64))
        t2.append(_pair(x, y).view(np.int64))
        at_.append(np.concatenate(sign) if sign else np.zeros(0, np.int64))
        n_.append(np.array(counts, np.int64))
    if not n_:
        return [], [], [], []
    n = np.concatenate(n_)
    return tuple(_lists(n, np.concatenate(v)) for v in (t0, t1, t2, at_))


def multikey_order(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their tokens, and how many leading tokens each shares with the one before it in that order.

    Multikey quicksort with all partitions of one depth in one call: sort by a token, then by the next token within every run that is
    still equal; runs of one suffix are done.
    """
    n = len(tokens[0])
    order = np.argsort(tokens[0], kind="stable")
    shared = np.zeros(n, np.int8)
    shared[1:] = tokens[0][order[1:]] == tokens[0][order[:-1]]
    for depth in range(1, len(tokens)):
        tied = shared == depth
        tied[:-1] |= shared[1:] == depth
        where = np.flatnonzero(tied)
        if not len(where):
            break
        run = np.cumsum(shared[where] < depth)
        sub = order[where]
        sub = sub[np.lexsort((tokens[depth][sub], run))]
        order[where] = sub
        same = np.zeros(len(where), bool)
        same[1:] = (tokens[depth][sub[1:]] == tokens[depth][sub[:-1]]) & (run[1:] == run[:-1])
        shared[where[same]] = depth + 1
    return order, shared


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket of suffixes and compares neighbours. Gives the repeated ones of contexts seen once, and the first and the
    last suffix of the bucket with their tokens (edge): their equals may be in the buckets beside it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    tokens = [t.column(c).to_numpy() for c in ("t0", "t1", "t2")]
    key, at = t.column("key").to_numpy(), t.column("at").to_numpy()
    order, shared = multikey_order(tokens)
    full = shared == len(tokens)
    again = full.copy()
    again[:-1] |= full[1:]
    hit = order[again]
    hit = hit[at[hit] > 0]
    ends = order[[0, -1]]
    rows = np.concatenate([hit, ends])
    edge = np.concatenate([np.zeros(len(hit), bool), np.ones(len(ends), bool)])
    for a in range(0, len(rows), 100_000):
        r = rows[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[r]), pa.array(at[r]), *(pa.array(x[r]) for x in tokens), pa.array(edge[a : a + 100_000])],
                                         ["key", "at", "t0", "t1", "t2", "edge"])


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, text`` as a table bucketed by key, in the shared folder: three joins read it, and texts are dealt out once."""
    spark = docs.sparkSession
    name = f"framewise_texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/framewise-llm/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("text"))
    rows.repartition(n, "key").write.bucketBy(n, "key").option("path", path).saveAsTable(name)
    return spark.table(name)


def repeated_ranges(docs: DataFrame, keyed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans``: per text with repeats the byte ranges [lo, hi) that repeated windows cover, in no order, overlapping."""
    raw = docs.select(row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("text"))
    names = ("lo", "hi", "mid", "k", "c", "left", "right")
    anchors = stage(map_batches(raw, contexts, dict.fromkeys(names, "array<long>")).select("key", F.inline(F.arrays_zip(*names))), "windows")
    context = anchors.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("copy"))
    context = stage(context, "contexts")
    anchor = context.groupBy("k").agg(F.sum("n").alias("total"), (F.sum((F.col("n") == 1).cast("int")) > 0).alias("open")).where("total > 1")
    matter = context.join(anchor, "k").where("n > 1 or open").select("k", "c", "n", "copy", "open")
    found = anchors.join(matter, ["k", "c"]).select("key", "lo", "hi", "mid", "left", "right", "n", "open", (F.col("key") == F.col("copy")).alias("copy"))
    found = stage(found, "anchors")
    known = found.where("n > 1").select("key", "lo", (F.col("hi") + WINDOW).alias("hi"))

    edge = F.col("mid") - HALF
    halves = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("h"), F.col("lo").alias("lo"), F.least("hi", edge).alias("hi")),
                     F.struct(F.lit(1).alias("side"), F.col("right").alias("h"), F.greatest("lo", edge + 1).alias("lo"), F.col("hi").alias("hi")))
    once = (F.col("n") == 1).alias("once")
    half = found.where("open and (n = 1 or copy)").select("key", "mid", once, F.inline(halves)).where("lo <= hi")
    met = half.groupBy("side", "h").agg(F.count(F.lit(1)).alias("m"), F.max("once").alias("any")).where("m > 1 and any").select("side", "h")
    todo = half.join(met, ["side", "h"]).groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "mid", "once")).alias("ranges"))
    names = ("lo", "hi", "core", "block", "once")
    cut = map_batches(keyed.select("key", "text").join(todo, "key"), blocks, dict.fromkeys(names, "array<long>"), reads=("text", "ranges"))
    cut = stage(cut.select("key", F.inline(F.arrays_zip(*names))), "blocks")
    kind = cut.groupBy("core", "block").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("copy"), F.max("once").alias("once"))
    core = kind.groupBy("core").agg(F.sum("n").alias("total"), F.max(((F.col("n") == 1) & (F.col("once") == 1)).cast("int")).alias("open")).where("total > 1")
    settled = cut.join(kind.drop("once").join(core, "core").where("n > 1 or open = 1"), ["core", "block"])
    settled = stage(settled.select("key", "lo", "hi", "once", "n", "open", (F.col("key") == F.col("copy")).alias("copy")), "settled")
    known = known.unionByName(settled.where("n > 1 and once = 1").select("key", "lo", (F.col("hi") + WINDOW).alias("hi")))

    last = settled.where("open = 1 and (n = 1 or copy)").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", ((F.col("n") == 1) & (F.col("once") == 1)).alias("once"))).alias("ranges"))
    made = map_batches(keyed.select("key", "text").join(last, "key"), suffixes, dict.fromkeys(("t0", "t1", "t2", "at"), "array<long>"), reads=("text", "ranges"))
    rows = stage(made.select("key", F.inline(F.arrays_zip("t0", "t1", "t2", "at"))), "suffixes")
    sorted_ = rows.repartitionByRange("t0", "t1", "t2", "key", "at").mapInArrow(_bucket, "key long, at long, t0 long, t1 long, t2 long, edge boolean")
    sorted_ = stage(sorted_, "neighbours")
    hits = sorted_.where("not edge").select("key", "at")
    edges = sorted_.where("edge").select("key", "at", "t0", "t1", "t2").distinct()
    twice = edges.groupBy("t0", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = hits.unionByName(edges.join(twice, ["t0", "t1", "t2"]).where("at > 0").select("key", "at"))
    fresh = hits.select("key", (F.col("at") - 1).alias("lo"), (F.col("at") - 1 + WINDOW).alias("hi"))
    return known.unionByName(fresh).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of [lo, hi) ranges; ranges that touch are one run."""
    if not spans:
        return []
    lo, hi = (np.array([s[c] for s in spans]) for c in ("lo", "hi"))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = np.flatnonzero(lo[1:] > hi[:-1])
    return list(zip(lo[np.concatenate([[0], cut + 1])].tolist(), hi[np.concatenate([cut, [len(hi) - 1]])].tolist(), strict=True))


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for a, b in runs:
        out.append(raw[done:a])
        done = b
    return b"".join([*out, raw[done:]])


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary), ``removed`` (start:end in bytes, comma-joined) for every row: each byte
    covered by a 400-byte string that also starts anywhere else, in the same text or another, is removed; strings are judged on the input.

    Most strings are settled by counting hashes of anchors, contexts and blocks; those at the ends of repeats are settled by the sort of
    suffixes. Equality is that of 128 or more hash bits; bytes are not compared again.

    Null and empty texts, and texts under 400 bytes, lose nothing. Rows repeated in id and text are repeats of each other. An
    empty table gives an empty result. A text's ranges are gathered in one row, which its own length bounds.
    """
    keyed = keyed_texts(docs, doc_id, text)

    def cut(texts: list[bytes | None], spans: list[list | None]) -> tuple:
        runs = [merged(s) for s in spans]
        kept = [without(t or b"", r) for t, r in zip(texts, runs, strict=True)]
        size = [len(t or b"") for t in texts]
        shown = [",".join(f"{a}:{b}" for a, b in r) for r in runs]
        return size, [n - len(k) for n, k in zip(size, kept, strict=True)], [len(r) for r in runs], kept, shown

    joined = keyed.join(repeated_ranges(docs, keyed, doc_id, text), "key", "left").drop("key")
    return map_batches(joined, cut, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "removed": "string"}, reads=("text", "spans"))


def brute_force(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    """What :func:`drop_repeats` must give, from a table of all windows; for small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - WINDOW + 1):
            seen[t[p : p + WINDOW]] = seen.get(t[p : p + WINDOW], 0) + 1
    out = []
    for t in texts:
        runs = merged([{"lo": p, "hi": p + WINDOW} for p in range(len(t) - WINDOW + 1) if seen[t[p : p + WINDOW]] > 1])
        kept = without(t, runs)
        out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
