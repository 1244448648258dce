"""Scoring by a small causal self-attention model, trained in numpy on subword ids, next to an add-one-tenth word model.

The model predicts the next subword from the few before it: an embedding with positions, one head of masked attention, a hidden
layer, and a softmax over the commonest subwords and one class for all others, which share its probability by their counts. To the
logits it adds the log-probabilities of the subword after the one before it, counted over the corpus; it starts from those.
A word's probability is the product over its subwords, interpolated with its share in the corpus counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import map_batches, row_key, slices, stage
from framewise.llm.pieces import LITERAL, MODEL, SPACE, Encoder, PieceModel
from framewise.llm.words import CHUNK_BYTES, chunks, find_words, hash_words

#: Subwords with a class of their own, rows of embeddings for the others, width, hidden units.
HEAD, REST, WIDTH, HIDDEN = 191, 64, 16, 32
#: Subwords a window shows, and how many of them (the last) it scores. Windows overlap by the difference.
SPAN, STEP = 24, 16
#: Rounds of averaged training, each on its own share of the documents; first rate; windows of a step; windows made at once.
ROUNDS, RATE, GROUP, BLOCK = 4, 0.004, 128, 1 << 14
#: Windows computed at once, and those whose logits are: their arrays stay in a core's cache.
CACHED, INNER = 64, 64
#: Subwords of a shard, which one task trains on in a row; rows that a task holds as lists.
SHARD, ROWS = 1 << 20, 512
#: Share of the attention model in the probability of a word; the rest goes by the word's count.
SHARE = 0.5
#: Word counts held by every task; rarer words are joined. 6 MB, whatever the corpus.
HELD = 1 << 19
END_WORD = np.uint64(0x5EED0FE2D0000001)
TREE = 64


@dataclass
class Vocabulary:
    """Classes of subword ids. ``out`` gives the class to predict, ``seen`` the row of the embedding, ``share`` log P(id | its class)."""

    out: np.ndarray
    seen: np.ndarray
    share: np.ndarray
    bigram: np.ndarray

    start: int = HEAD + REST

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        """From counts of all ids, the last of them the end."""
        n = len(counts)
        order = np.lexsort((np.arange(n), -counts.astype(float)))
        order = np.concatenate([[n - 1], order[order != n - 1]])
        out = np.full(n, HEAD, np.int64)
        head = order[:HEAD]
        out[head] = np.arange(len(head))
        seen = np.where(out < HEAD, out, HEAD + np.arange(n) % REST)
        rest = (counts + 0.1) * (out == HEAD)
        share = np.where(out == HEAD, np.log(np.maximum(rest, 1e-300) / max(rest.sum(), 1e-300)), 0.0)
        return Vocabulary(out, seen, share.astype(np.float32), np.zeros((HEAD + REST + 1, HEAD + 1), np.float32))

    def smooth(self, pairs: np.ndarray) -> None:
        """Bigram log-probabilities from counts (row of the one before, class), towards the classes' own shares."""
        one = pairs.sum(0) + 0.5
        base = one / one.sum()
        self.bigram = np.log((pairs + 20 * base) / (pairs.sum(1, keepdims=True) + 20)).astype(np.float32)


SHAPES = {"e": (HEAD + REST + 2, WIDTH), "p": (SPAN, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
          "a": (WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, WIDTH), "u": (WIDTH, HEAD + 1)}
Weights = dict[str, np.ndarray]
PAD = HEAD + REST + 1


def initial(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    return {n: (rng.standard_normal(s) * (0.0 if n in "ub" else 0.3 if n in "ep" else 0.25)).astype(np.float32) for n, s in SHAPES.items()}


def packed(w: Weights) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in SHAPES])


def _views(flat: np.ndarray) -> Weights:
    """The weights as parts of one array, in the order of SHAPES."""
    out, at = {}, 0
    for n, s in SHAPES.items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s)
        at += size
    return out


def unpacked(flat: np.ndarray) -> Weights:
    return _views(flat.astype(np.float32))


#: 1 where a place is not after the one that looks.
_SEEN = np.tril(np.ones((SPAN, SPAN), np.float32))
#: Weights are used without their greatest taken off first, unless their sum leaves these bounds.
LEAST, MOST = 1e-25, 1e30


def _off(total: np.ndarray) -> np.ndarray:
    """Rows whose weights came too near the ends of single precision: far from any trained model."""
    return np.flatnonzero(~((total > LEAST) & (total < MOST)))


def _times(a: np.ndarray, b: np.ndarray, places: int) -> np.ndarray:
    """``a @ b``, ``places`` rows of ``a`` at a time if not 0. One product of all rows is faster, but rounds each by its place among them."""
    return (a.reshape(-1, places, a.shape[1]) @ b).reshape(len(a), -1) if places else a @ b


def _body(w: Weights, x: np.ndarray, scored: int, apart: bool) -> tuple:
    """All layers but the last, at the last ``scored`` places of windows ``x`` of rows (PAD where there is nothing), which stand one below
    the other in a matrix. Attention is masked to earlier places that hold something. Windows have products of their own if ``apart``."""
    n, places = len(x), scored * apart
    h = np.take(w["e"], x, axis=0)
    h += w["p"]
    last = h[:, -scored:].reshape(-1, WIDTH)
    q = _times(last, w["q"] * w["q"].dtype.type(WIDTH**-0.5), places).reshape(n, scored, WIDTH)
    kv = _times(h.reshape(-1, WIDTH), np.concatenate([w["k"], w["v"]], 1), SPAN * apart).reshape(n, SPAN, 2 * WIDTH)
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    s = q @ k.transpose(0, 2, 1)
    np.exp(s, out=s)
    s *= _SEEN[-scored:]
    some = np.flatnonzero((x[:, 0] == PAD) | (x[:, -1] == PAD))
    s[some] *= (x[some] != PAD)[:, None, :]
    total = s.reshape(-1, SPAN) @ np.ones(SPAN, s.dtype)
    for r in _off(total):
        i, j = divmod(int(r), scored)
        one = np.where((x[i] != PAD) & (_SEEN[j - scored] > 0), k[i] @ q[i, j], -np.inf)
        s[i, j] = np.exp(one - one.max())
        total[r] = s[i, j].sum()
    part = (1 / total)[:, None]
    z = (s @ v).reshape(-1, WIDTH)
    z *= part
    y = _times(z, w["o"], places)
    y += last
    act = _times(y, w["a"], places)
    act += w["b"]
    np.maximum(act, 0, out=act)
    top = _times(act, w["c"], places)
    top += y
    return top, (h, last, q, k, v, s, part, z, y, act)


def _head(u: np.ndarray, top: np.ndarray, row: np.ndarray, bigram: np.ndarray, out: np.ndarray, room: np.ndarray, places: int) -> np.ndarray:
    """Writes the weights of the classes of some places to ``out`` and gives their sums; ``room`` holds the logits of the rows before."""
    if places:
        np.matmul(top.reshape(-1, places, WIDTH), u, out=out.reshape(-1, places, out.shape[1]))
    else:
        np.matmul(top, u, out=out)
    out += np.take(bigram, row, axis=0, out=room, mode="clip")
    np.exp(out, out=out)
    total = out @ np.ones(out.shape[1], out.dtype)
    for r in _off(total):
        one = top[r] @ u + bigram[row[r]]
        out[r] = np.exp(one - one.max())
        total[r] = out[r].sum()
    return total


def _rooms(w: Weights, bigram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.empty((rows, HEAD + 1), w["u"].dtype), np.empty((rows, HEAD + 1), bigram.dtype)


def _before(x: np.ndarray, scored: int) -> np.ndarray:
    return np.minimum(x[:, -scored:], HEAD + REST).reshape(-1)


def forward(w: Weights, x: np.ndarray, bigram: np.ndarray, scored: int = STEP) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Weights of the classes (windows, scored, classes) and their sums at the last ``scored`` places of windows ``x``; a weight over its sum
    is a probability."""
    with np.errstate(over="ignore", invalid="ignore"):
        top, kept = _body(w, x, scored, True)
        out, room = _rooms(w, bigram, len(top))
        total = _head(w["u"], top, _before(x, scored), bigram, out, room, scored)
    return out.reshape(len(x), scored, -1), total.reshape(len(x), scored), kept


def gradient(w: Weights, x: np.ndarray, target: np.ndarray, bigram: np.ndarray) -> tuple[float, Weights]:
    """Mean loss of the places whose target is not -1, and its gradient; CACHED windows at a time."""
    flat = np.zeros(sum(map(np.size, w.values())), w["u"].dtype)
    g = _views(flat)
    return _gradient(w, x, target, bigram, g, _rooms(w, bigram, INNER * target.shape[1])), g


def _gradient(w: Weights, x: np.ndarray, target: np.ndarray, bigram: np.ndarray, g: Weights, rooms: tuple[np.ndarray, np.ndarray]) -> float:
    """Adds the gradient to ``g``; the loss."""
    n = max(1, int((target >= 0).sum()))
    with np.errstate(over="ignore", invalid="ignore"):
        return sum(_part(w, x[a : a + CACHED], target[a : a + CACHED], bigram, n, g, rooms) for a in range(0, len(x), CACHED))


def _part(w: Weights, x: np.ndarray, target: np.ndarray, bigram: np.ndarray, n: int, g: Weights, rooms: tuple[np.ndarray, np.ndarray]) -> float:
    """What some windows add to the loss and the gradient of ``n`` places."""
    scored = target.shape[1]
    top, (h, last, q, k, v, s, part, z, y, act) = _body(w, x, scored, False)
    row, goal = _before(x, scored), target.reshape(-1)
    used = (goal >= 0).astype(top.dtype)
    used /= n
    dtop, loss, step = np.empty_like(top), 0.0, len(rooms[0])
    for a in range(0, len(top), step):
        e = min(a + step, len(top))
        d = rooms[0][: e - a]
        total = _head(w["u"], top[a:e], row[a:e], bigram, d, rooms[1][: e - a], 0)
        at = np.arange(0, d.size, d.shape[1]) + np.maximum(goal[a:e], 0)
        loss -= float(used[a:e] @ np.log(d.reshape(-1)[at] / total + 1e-30))
        d.reshape(-1)[at] -= total
        share = (used[a:e] / total)[:, None]
        g["u"] += (d.T @ (top[a:e] * share)).T
        np.matmul(d, w["u"].T, out=dtop[a:e])
        dtop[a:e] *= share
    dact = dtop @ w["c"].T
    dact *= act > 0
    g["c"] += act.T @ dtop
    g["b"] += dact.sum(0)
    g["a"] += y.T @ dact
    dy = dact @ w["a"].T
    dy += dtop
    g["o"] += z.T @ dy
    dz = dy @ w["o"].T
    dz *= part
    own = np.einsum("ij,ij->i", dz, z)
    dz = dz.reshape(q.shape)
    ds = dz @ v.transpose(0, 2, 1)
    ds -= own.reshape(*q.shape[:2], 1)
    ds *= s
    dkv = np.empty((len(x), SPAN, 2 * WIDTH), h.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
    np.matmul(s.transpose(0, 2, 1), dz, out=dkv[..., WIDTH:])
    dq = (ds @ k).reshape(-1, WIDTH)
    dq *= dq.dtype.type(WIDTH**-0.5)
    g["q"] += last.T @ dq
    flat = dkv.reshape(-1, 2 * WIDTH)
    both = h.reshape(-1, WIDTH).T @ flat
    g["k"] += both[:, :WIDTH]
    g["v"] += both[:, WIDTH:]
    dh = (flat @ np.concatenate([w["k"], w["v"]], 1).T).reshape(h.shape)
    dy += dq @ w["q"].T
    dh[:, -scored:] += dy.reshape(len(x), scored, WIDTH)
    g["p"] += dh.sum(0)
    rows = x.reshape(-1).astype(np.int16)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    g["e"][rows[first]] += np.add.reduceat(np.take(dh.reshape(-1, WIDTH), order, axis=0), first, axis=0)
    return loss


def windows(ids: np.ndarray, counts: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of every text: rows seen (windows, SPAN), classes to predict (windows, STEP), -1 past the end, and whose they are.

    Place i sees the subword before i. Each place is scored in one window, as one of its last STEP places; the places before
    them are context from the window before.
    """
    n = -(-counts // STEP)
    owner = np.repeat(np.arange(len(counts)), n)
    begin, opens = np.cumsum(counts) - counts, np.cumsum(n) - n
    at = np.repeat(opens * STEP - begin, counts)
    at += np.arange(len(ids))
    target = np.full(len(owner) * STEP, -1, np.int16)
    target[at] = voc.out.astype(np.int16)[ids]
    before = np.roll(voc.seen.astype(np.int16)[ids], 1)
    before[begin[counts > 0]] = voc.start
    seen = np.full(len(owner) * STEP, PAD, np.int16)
    seen[at] = before
    seen = seen.reshape(-1, STEP)
    x = np.full((len(owner), SPAN), PAD, np.int16)
    x[:, -STEP:] = seen
    x[1:, :-STEP] = seen[:-1, 2 * STEP - SPAN :]
    x[opens[counts > 0], :-STEP] = PAD
    return x, target.reshape(-1, STEP), owner


def log_probabilities(w: Weights, voc: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log of the probability of every id of all texts, given the ids before it in its text. The numbers of a window don't
    depend on those beside it: products are made window by window, sums over INNER windows (filled up at the end)."""
    x, target, _ = windows(ids, counts, voc)
    n = len(x)
    x = np.concatenate([x, np.full((-n % INNER, SPAN), voc.start, np.int16)])
    got = np.ones(len(x) * STEP)
    out, room = _rooms(w, voc.bigram, INNER * STEP)
    rows = np.arange(0, out.size, out.shape[1])
    goal = np.maximum(target, 0).reshape(-1)
    goal = np.concatenate([goal, np.zeros(len(got) - len(goal), np.int16)])
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, n, INNER):
            part = x[a : a + INNER].astype(np.intp)
            top, _ = _body(w, part, STEP, True)
            total = _head(w["u"], top, _before(part, STEP), voc.bigram, out, room, STEP)
            here = slice(a * STEP, (a + INNER) * STEP)
            got[here] = out.reshape(-1)[rows + goal[here]] / total
    return np.log(got[: n * STEP][target.reshape(-1) >= 0] + 1e-30) + voc.share[ids]


def train(flat: np.ndarray, voc: Vocabulary, runs: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> tuple[np.ndarray, int]:
    """One pass of Adam over all windows of the texts in ``runs`` (ids, ids per text), GROUP windows a step, mixed within BLOCK;
    (weights, windows)."""
    flat = flat.astype(np.float32)
    m, s2, g = (np.zeros_like(flat) for _ in range(3))
    w, by_name = _views(flat), _views(g)
    rooms = _rooms(w, voc.bigram, INNER * STEP)
    step = seen = 0
    for ids, counts in runs:
        every, targets, _ = windows(ids, counts, voc)
        for a in range(0, len(every), BLOCK):
            x, target = every[a : a + BLOCK].astype(np.intp), targets[a : a + BLOCK].astype(np.intp)
            seen += len(x)
            for k in np.array_split(np.random.default_rng(seen).permutation(len(x)), -(-len(x) // GROUP)):
                g[:] = 0
                _gradient(w, x[k], target[k], voc.bigram, by_name, rooms)
                step += 1
                m *= 0.9
                m += 0.1 * g
                s2 *= 0.99
                s2 += 0.01 * g**2
                flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-6)
    return flat, seen


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def subwords(texts: list[bytes], encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of lower-cased texts (A-Z), one space between any two, and the end of each; ids per text; ids per word,
    the end of a text counting as its last word. No piece crosses words, so each distinct one (64-bit hash) is encoded once."""
    w = find_words([t.lower() for t in texts])
    h = hash_words(w)
    bare = np.zeros(len(h), bool)
    if not encoder.model.prefix:
        bare[w.first[:-1][np.diff(w.first) > 0]] = True
        h = h ^ bare.astype(np.uint64)

    def units(which: np.ndarray) -> list[str]:
        size = w.end[which] - w.start[which] + 1
        ends = np.cumsum(size)
        data = w.data[np.arange(ends[-1]) + np.repeat(w.start[which] - (ends - size), size)]
        data[ends - 1] = 10
        made = data.tobytes().decode("utf-8", "replace").replace(SPACE, LITERAL).split("\n")
        return [u if b else SPACE + u for u, b in zip(made, bare[which].tolist())]

    ids, size = encoder.encode_hashed(h, units)
    counts = np.diff(np.concatenate([[0], np.cumsum(size)])[w.first])
    end = len(encoder.model.texts)
    return np.insert(ids.astype(np.int64), np.cumsum(counts), end), counts + 1, np.insert(size, w.first[1:], 1)


class _Lazy:
    """An encoder made in each task on first use."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.made = model, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "made": None}

    def get(self) -> Encoder:
        self.made = self.made or Encoder(self.model)
        return self.made


def word_counts(rows: DataFrame) -> DataFrame:
    """``h, c``: how often each word (64-bit hash) and the end of a text occur in the ``text`` of ``rows``; counted first where read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            for _, run in chunks(b.column("text").to_pylist()):
                h = hash_words(find_words([t.lower() for t in run]))
                kinds, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(kinds, END_WORD).view(np.int64)), pa.array(np.append(n, len(run)))], ["h", "c"])

    return rows.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _id_type(model: PieceModel) -> np.dtype:
    return np.dtype("<u2" if len(model.texts) < 1 << 16 else "<i4")


def encoded(rows: DataFrame, model: PieceModel) -> DataFrame:
    """``rows`` and, of every whole ``text``, its subwords and its end as bytes (``ids``, see :func:`id_runs`) and a bit for each, set
    where a word starts (``opens``)."""
    lazy, kind = _Lazy(model), _id_type(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            made, opens = [], []
            for _, run in chunks(b.column("text").to_pylist()):
                ids, counts, per_word = subwords(run, lazy.get())
                first = np.zeros(len(ids), bool)
                first[np.cumsum(per_word) - per_word] = True
                ids, ends = ids.astype(kind), np.cumsum(counts)
                for a, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    made.append(ids[a:e].tobytes())
                    opens.append(np.packbits(first[a:e]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary()), pa.array(opens, pa.binary())], [*b.schema.names, "ids", "opens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(encode, f"{schema}, ids binary, opens binary")


def id_runs(lists: list[bytes], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids per text) of runs of whole texts."""
    for _, run in chunks(lists):
        yield np.frombuffer(b"".join(run), kind).astype(np.int64), np.fromiter(map(len, run), np.int64, len(run)) // kind.itemsize


def shard_runs(lists: Iterator[bytes], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same as :func:`id_runs` of a stream of texts: where a run ends depends on the texts alone, not on the batches they came in."""
    held, size = [], 0
    for x in lists:
        held.append(x)
        size += len(x)
        if size >= CHUNK_BYTES:
            yield from id_runs(held, kind)
            held, size = [], 0
    yield from id_runs(held, kind)


def apart(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, ids`` of ``rows``, each shard in a partition of its own, in the order of ``key``: by the number of the shard itself, since its
    hash puts several of them into one partition and leaves others empty."""
    return rows.repartitionById(min(shards, 1 << 14), F.col("shard").cast("int")).sortWithinPartitions("shard", "key").select("shard", "ids")


def learn(train_rows: DataFrame, model: PieceModel) -> tuple[np.ndarray, Vocabulary]:
    """Trains on every window of every training document (rows of :func:`encoded`), the same way however the rows are split.

    Subwords and pairs of whole texts are counted in each task and summed by Spark. Each round deals its share of the documents to
    shards by hash, about SHARD subwords each, and sorts a shard by key. Every shard is trained on from the same weights, and the mean of
    the results, weighted by windows and summed in the order of shards, opens the next round. Shards are summed in TREE groups first, so that
    the driver reads at most TREE vectors of 10,000 numbers.
    """
    size, kind = len(model.texts) + 1, _id_type(model)

    def tally(batches: Iterator[pa.RecordBatch], voc: Vocabulary | None, length: int) -> Iterator[pa.RecordBatch]:
        n = np.zeros(length, np.int64)
        for b in slices(batches, ROWS):
            for ids, counts in id_runs(b.column("ids").to_pylist(), kind):
                k = ids
                if voc is not None:
                    before = voc.seen[np.roll(ids, 1)]
                    before[np.cumsum(counts) - counts] = voc.start
                    k = before * (HEAD + 1) + voc.out[ids]
                n += np.bincount(k, minlength=length)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["k", "n"])

    def total(voc: Vocabulary | None, length: int) -> np.ndarray:
        out = np.zeros(length)
        for r in train_rows.select("ids").mapInArrow(lambda it: tally(it, voc, length), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            out[r.k] = r.n
        return out

    counts = total(None, size)
    voc = Vocabulary.of(counts)
    voc.smooth(total(voc, (HEAD + REST + 1) * (HEAD + 1)).reshape(HEAD + REST + 1, HEAD + 1))
    flat = packed(initial())
    shards = 1 + int(counts.sum()) // (ROUNDS * SHARD)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard, each in the order of keys."""
        parts = ((s, sub) for b in slices(batches, ROWS) for s, sub in by_shard(b))
        for shard, group in groupby(parts, key=lambda x: x[0]):
            now, seen = train(flat, voc, shard_runs((x for _, lists in group for x in lists), kind), rate)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([float(seen)]), pa.array([now.astype(np.float64) * seen], pa.list_(pa.float64()))], ["shard", "n", "w"])

    def by_shard(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        s, lists = b.column("shard").to_numpy(), b.column("ids").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
        yield from ((int(s[i]), lists[i:j]) for i, j in zip(cuts, cuts[1:]) if j > i)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of groups of shards, each in the order of shards."""
        sums: dict[int, tuple] = {}
        for b in batches:
            for k in range(b.num_rows):
                g = b.column("shard")[k].as_py() % TREE
                n, w = sums.get(g, (0.0, 0.0))
                sums[g] = n + b.column("n")[k].as_py(), w + np.array(b.column("w")[k].values)
        for g, (n, w) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([n]), pa.array([w], pa.list_(pa.float64()))], ["g", "n", "w"])

    drawn = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(ROUNDS * shards))
    dealt = train_rows.select("key", "ids", (drawn % ROUNDS).alias("round"), F.floor(drawn / ROUNDS).alias("shard"))
    for r in range(ROUNDS):
        rate = RATE * (1 - r / ROUNDS)
        part = apart(dealt.where(F.col("round") == r), shards)
        trained = part.mapInArrow(local, "shard long, n double, w array<double>")
        groups = trained.repartition(min(shards, TREE), F.col("shard") % TREE).sortWithinPartitions("shard").mapInArrow(add, "g long, n double, w array<double>")
        sums = sorted(groups.collect(), key=lambda x: x.g)
        if sums:
            flat = (np.sum([np.array(x.w) for x in sums], 0) / sum(x.n for x in sums)).astype(np.float32)
    return flat, voc


def interpolated(by_subwords: np.ndarray, c: np.ndarray, below: float) -> np.ndarray:
    """log10 probability per word: SHARE of what attention gives its subwords together (log10), and the rest by its count."""
    by_count = np.log10(c + 0.1) - below
    return np.logaddexp2((by_subwords + np.log10(SHARE)) * np.log2(10), (by_count + np.log10(1 - SHARE)) * np.log2(10)) * np.log10(2)


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Rows whose crc32(id) mod 10 is not 0 (a null id counts as the empty string) are learned from; all are scored, on whole texts. A null or
    empty text is one token, its end. Repeated rows get the same row. An empty table gives an empty result. Words are counted by
    64-bit hash. Counts of the HELD commonest words go to every task; for all others a row per document and word is joined.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (_fold(F.col(doc_id)) == 0).alias("held_out"), row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("text"))
    pieces = PieceModel.load(model)
    rows = stage(encoded(rows, pieces), "encoded")
    counts = stage(word_counts(rows.where("not held_out")), "words")
    ends = F.coalesce(F.sum(F.when(F.col("h") == int(END_WORD.view(np.int64)), F.col("c"))), F.lit(0))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), ends.alias("ends")).first()
    n, v, end = whole.n or 0, whole.v, whole.ends
    common = counts.orderBy(F.desc("c"), "h").limit(HELD).toArrow()
    known, times = common.column("h").to_numpy().view(np.uint64), common.column("c").to_numpy()
    order = np.argsort(known)
    known, times = known[order], times[order]
    below = float(np.log10(n + 0.1 * (v + 1)))
    flat, voc = learn(rows.where("not held_out"), pieces)
    kind = _id_type(pieces)

    def score(texts: list[bytes | None], lists: list[bytes], opens: list[bytes]) -> tuple:
        weights = unpacked(flat)
        tokens, found, base, model_score, rare, logs, sizes = [], [], [], [], [], [], []
        for begin, run in chunks(texts):
            w = find_words([t.lower() for t in run])
            h = hash_words(w)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            c = np.where(known[at] == h, times[at], 0) if len(known) else np.zeros(len(h), np.int64)
            hit = c > 0
            size = np.diff(w.first)
            count = lambda x: np.bincount(w.owner, x, len(run))  # noqa: B023, E731
            tokens.append(size + 1)
            found.append(count(hit).astype(np.int64) + int(end > 0))
            base.append(count(np.where(hit, np.log10(c + 0.1), 0.0)) + np.log10(end + 0.1) - below * (size + 1))
            rare.append(h[~hit].view(np.int64))
            sizes.append(count(~hit).astype(np.int64))
            own = lists[begin : begin + len(run)]
            n_ids = np.fromiter(map(len, own), np.int64, len(own)) // kind.itemsize
            ids = np.frombuffer(b"".join(own), kind).astype(np.int64)
            first = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=n) for o, n in zip(opens[begin : begin + len(run)], n_ids.tolist(), strict=True)])
            by_subwords = np.add.reduceat(log_probabilities(weights, voc, ids, n_ids), np.flatnonzero(first)) / np.log(10)
            held = np.insert(hit, w.first[1:], True)
            words = np.where(held, interpolated(by_subwords, np.insert(c, w.first[1:], end), below), 0.0)
            model_score.append(np.add.reduceat(words, np.cumsum(size + 1) - size - 1))
            logs.append(by_subwords[~held])
        if not tokens:
            return [], [], [], [], [], []
        return (*map(np.concatenate, (tokens, found, base, model_score)), *(_lists(np.concatenate(x), np.concatenate(sizes)) for x in (rare, logs)))

    made = map_batches(rows.drop("key"), score, most=ROWS, reads=("text", "ids", "opens"), columns={"n_tokens": "long", "known": "long", "base": "double", "score": "double", "rare": "array<long>", "logs": "array<double>"})
    scored = stage(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    return _with_rare(scored, counts, n, below)


def _with_rare(scored: DataFrame, counts: DataFrame, n: int, below: float) -> DataFrame:
    """Adds the words beyond HELD: their counts come by a join on the word, and their sums by one on the row. Each brings the log10
    probability of its subwords, so that it is interpolated with its own count as the others are (:func:`interpolated`)."""
    words = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("logs").alias("s"))))
    c = F.coalesce("c", F.lit(0)) + 0.1
    both = F.log10(SHARE * F.pow(F.lit(10.0), "s") + (1 - SHARE) * F.pow(F.lit(10.0), F.log10(c) - below))
    more = words.join(counts, "h", "left").groupBy("row").agg(F.sum(F.log10(c)).alias("more"), F.sum(both).alias("mixed"), F.count("c").alias("seen"))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"))
