"""MinHash near-duplicates with min-max signatures, exact confirmation and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import fresh, map_batches, mix64, row_key, stage
from framewise.llm.graph import components
from framewise.llm.words import chunks, find_words, hash_shingles, hash_words


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of n permutations of the 64-bit numbers: (x xor mask) * odd factor."""
    keys = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return keys[:n], keys[n:] | np.uint64(1)


def signatures(texts: list[bytes | None], n: int, perms: int, width: int) -> tuple:
    """Per text: number of distinct shingles, two hashes of the whole set, a key per band, and one byte of each value (a sketch).

    Under each permutation both the smallest and the largest value are kept: two samples for one evaluation, each agreeing with
    probability J, and their errors partly cancel. A band is ``width`` such values, in pairs of minimum and maximum.
    """
    mask, factor = permutations(perms)
    sizes, one, two, bands, sketches = [], [], [], [], []
    with np.errstate(over="ignore"):
        for _, run in chunks(texts):
            w = find_words([t.lower() for t in run])
            s, begin = hash_shingles(hash_words(w), w.first, n)
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                s[a:b].sort()
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            new[begin[:-1][begin[:-1] < len(s)]] = True
            before = np.concatenate([[0], np.cumsum(new)])
            begin, s = before[begin], s[new]
            count = np.diff(begin)
            full = np.flatnonzero(count)
            at = begin[:-1][full]
            sig = np.empty((len(full), 2 * perms), np.uint64)
            sums = np.zeros((2, len(run)), np.uint64)
            if len(full):
                sums[0, full] = np.add.reduceat(mix64(s), at)
                sums[1, full] = np.add.reduceat(mix64(s + np.uint64(0x9E3779B97F4A7C15)), at)
                for k in range(perms):
                    v = (s ^ mask[k]) * factor[k]
                    sig[:, 2 * k], sig[:, 2 * k + 1] = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
            keys = np.zeros((len(full), 2 * perms // width), np.uint64)
            for j in range(width):
                keys = mix64(keys + sig[:, j::width] + np.arange(1, keys.shape[1] + 1, dtype=np.uint64))
            own = np.zeros(len(run), np.int64)
            own[full] = keys.shape[1]
            sizes.append(count)
            one.append(sums[0].view(np.int64))
            two.append(sums[1].view(np.int64))
            bands.append((own, keys.reshape(-1).view(np.int64)))
            bytes_ = np.zeros((len(run), 2 * perms), np.uint8)
            bytes_[full] = mix64(sig) >> np.uint64(56)
            sketches += [x.tobytes() for x in bytes_]
    if not sizes:
        return [], [], [], [], []
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([o for o, _ in bands]))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([k for _, k in bands])))
    return np.concatenate(sizes), np.concatenate(one), np.concatenate(two), lists, sketches


def shingle_set(text: bytes, n: int) -> set:
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def least_matches(percent: int, values: int) -> float:
    """Sketch bytes that must agree: six standard errors below the bound, so that fewer than one link in 10**8 is passed over."""
    j = percent / 100
    return values * (j - 6 * (j * (1 - j) / values) ** 0.5)


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose whole shingle sets overlap by ``percent`` or more. Sketches pass over pairs far below the bound
    before any text is moved; Spark splits the rows of a hub where they are many."""

    def close(a: list[bytes], b: list[bytes]) -> tuple:
        if not a:
            return [],
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(a), -1) for s in (a, b))
        return (x == y).sum(1) >= least_matches(percent, x.shape[1]),

    def linked(a: list[bytes], b: list[bytes]) -> tuple:
        out, last, held = [], None, set()
        for x, y in zip(a, b, strict=True):
            if x != last:
                last, held = x, shingle_set(x, n)
            other = shingle_set(y, n)
            both = len(held & other)
            out.append(100 * both >= percent * (len(held) + len(other) - both))
        return out,

    sketch = pairs.join(classes.select(F.col("c").alias("v"), F.col("sketch").alias("b")), "v").join(classes.select(F.col("c").alias("u"), F.col("sketch").alias("a")), "u")
    hopeful = stage(map_batches(sketch.select("u", "v", "a", "b"), close, {"close": "boolean"}, reads=("a", "b")).where("close").select("u", "v"), "hopeful")
    member = hopeful.join(texts.select(F.col("c").alias("v"), F.col("text").alias("b")), "v")
    rows = member.join(texts.select(F.col("c").alias("u"), F.col("text").alias("a")), "u").select("u", "v", "a", "b")
    return map_batches(rows, linked, {"linked": "boolean"}, reads=("a", "b")).where("linked").select("u", "v")


#: Classes of a bucket that are compared in one go; a larger bucket is cut into blocks, and blocks meet two at a time.
BLOCK = 1024


def sorted_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    for _, run in chunks(texts):
        w = find_words([t.lower() for t in run])
        s, begin = hash_shingles(hash_words(w), w.first, n)
        out += [np.unique(s[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return out


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of the others."""
    flat = np.concatenate(others)
    inside = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    return np.add.reduceat(inside.astype(np.int64), np.cumsum(sizes) - sizes)


def _across(n: int, percent: int):
    """Reads rows sorted by (band, i, j): blocks i and j of one bucket. Gives the links between classes of different components.

    A pair that shares several bands is taken in the first of them only, by the whole band keys: equal sketch bytes don't make a
    band shared, and the pair would never meet in that bucket. Sizes and sketches pass over pairs that
    can't reach the bound; the others are compared by their whole sets. Classes that a link has joined are not compared again.
    """

    def links(block: np.ndarray, i: int, j: int, slot: int, c: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: np.ndarray, bands: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        need, root, held = least_matches(percent, sketch.shape[1]), root.copy(), {}
        for a in range(0, len(left), 64):
            p = left[a : a + 64]
            fit = (root[p][:, None] != root[right]) & (100 * np.minimum(size[p][:, None], size[right]) >= percent * np.maximum(size[p][:, None], size[right]))
            if i == j:
                fit &= p[:, None] < right
            x, y = np.nonzero(fit)
            q, r = p[x], right[y]
            keep = np.concatenate([(sketch[q[k : k + 65536]] == sketch[r[k : k + 65536]]).sum(1) >= need for k in range(0, len(q), 65536)] or [np.zeros(0, bool)])
            q, r = q[keep], r[keep]
            here = np.concatenate([(bands[q[k : k + 65536]] == bands[r[k : k + 65536]]).argmax(1) == slot for k in range(0, len(q), 65536)] or [np.zeros(0, bool)])
            q, r = q[here], r[here]
            new = [k for k in np.unique(np.concatenate([q, r])).tolist() if k not in held]
            held.update(zip(new, sorted_sets([texts[k] for k in new], n), strict=True))
            for one in np.unique(q):
                other = r[(q == one)]
                other = other[root[other] != root[one]]
                if len(other):
                    both = overlaps(held[one], [held[k] for k in other.tolist()])
                    for k in other[100 * both >= percent * (size[one] + size[other] - both)]:
                        if root[k] != root[one]:
                            root[root == root[k]] = root[one]
                            yield min(c[one], c[k]), max(c[one], c[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple = ()

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            bands = pc.list_flatten(t.column("bands")).to_numpy().reshape(t.num_rows, -1)
            found = list(links(t.column("block").to_numpy(), now[1], now[2], t.column("slot")[0].as_py(), *(t.column(x).to_numpy() for x in ("c", "n", "root")), sketch, bands, t.column("text").to_pylist()))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            band, i, j = (b.column(x).to_numpy() for x in ("band", "i", "j"))
            cut = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip([0, *cut], [*cut, b.num_rows], strict=True):
                group = (band[s], i[s], j[s])
                if held and group != now:
                    yield from flush()
                    held = []
                now = group
                held.append(b.slice(s, e - s))
        if held:
            yield from flush()

    return run


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, perms: int = 64, width: int = 4) -> DataFrame:
    """``doc_id, key, n_shingles, c, component_id``, a row per row of ``docs``; ``c`` names its component, null if its set is empty.

    Texts with the same set form a class, and one text stands for it from here on. Classes that share a band meet in its bucket.
    First each bucket compares one class with the others, the one that meets most classes in all its buckets, as the text that
    the others were copied from does: stars, which join nearly every group of copies. Then only
    buckets that still hold several components go on. Their classes are compared, in blocks, with classes of other components
    whose size and sketch allow the bound, on whole sets. So all links of a bucket that could change a component are found, while
    no pair but a link leaves its task.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("text"))
    made = map_batches(raw, lambda t: signatures(t, n, perms, width), {"n_shingles": "long", "one": "long", "two": "long", "bands": "array<long>", "sketch": "binary"})
    marks = stage(made.withColumn("c", F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "one", "two"))).drop("one", "two"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n_shingles", "bands", "sketch"))
    classes = stage(marks.where("c is not null").groupBy("c").agg(first.alias("m")).select("c", "m.doc_id", "m.key", F.col("m.n_shingles").alias("n"), "m.bands", "m.sketch"), "classes")

    bands = classes.select("c", "n", F.posexplode("bands").alias("slot", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stage(bands.join(shared, "band"), "members")
    known = members.join(members.groupBy("c").agg(F.sum("m").alias("met")), "c")
    hub = known.groupBy("band").agg(F.max(F.struct("met", "c")).alias("hub")).select("band", F.col("hub.c").alias("hub"))
    buckets = stage(members.join(hub, "band"), "buckets")
    wanted = buckets.select("c").distinct().join(classes.select("c", "key"), "c")
    whole = docs.select(row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("text"))
    texts = stage(whole.join(wanted, "key").groupBy("c").agg(F.first("text").alias("text")), "texts")

    hubs = classes.select(F.col("c").alias("hub"), F.col("n").alias("hub_n"))
    pairs = buckets.where("c <> hub").select("hub", "c", "n").distinct().join(hubs, "hub").where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
    stars = stage(pairs.select(F.least("hub", "c").alias("u"), F.greatest("hub", "c").alias("v")).distinct(), "stars")
    links = stage(_confirmed(stars, classes, texts, n, percent), "links")
    root = components(links)

    placed = buckets.join(root.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = (placed.where("m > 2").join(mixed.select("band"), "band").withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "slot", "c", "n", "root")
            .join(classes.select("c", "sketch", "bands"), "c").join(texts, "c"))
    found = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across(n, percent), "u long, v long")
    new = stage(found, "links")
    if not new.isEmpty():
        root = components(links.unionByName(new))
    named = classes.select("c", "doc_id").join(root.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    where = named.join(least, "root").select("c", "root", "component_id")
    joined = marks.select("doc_id", "key", "n_shingles", "c").join(where, "c", "left")
    return joined.select("doc_id", "key", "n_shingles", F.coalesce("root", "c").alias("c"),
                         F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, perms: int = 64, width: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: sets of n-word shingles, linked at ``percent`` of their union.

    Null texts and texts without words have an empty set, link with nothing and stay. Repeated rows get the same row. A row
    without an id takes part; its component is the smallest id it reaches, or null. An empty table gives an empty result.
    """
    found = groups(docs, doc_id, text, n, percent, perms, width)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component (its smallest id), and all empty texts.

    Rows equal in id and text count as one; of equal texts the smallest id stays, a null id only if there is no other. Null texts are
    empty. An empty table stays empty.
    """
    found = groups(docs, doc_id, text, n, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")
    stay = found.where("c is not null").groupBy("c").agg(best).select(F.col("m.key").alias("key"))
    stay = stay.unionByName(found.where("c is null").select("key")).distinct()
    key = fresh(docs, "_key")
    return docs.withColumn(key, row_key(doc_id, text)).dropDuplicates([key]).join(stay.withColumnRenamed("key", key), key, "left_semi").drop(key)


#: DuckDB text of :func:`near_duplicates` by brute force over pairs that share a shingle; {n} words, {percent}.
NEAR_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= {n} then list_transform(range(1, len(ws) - {n} + 2), lambda i: list_slice(ws, i, i + {n} - 1))
                                      when len(ws) > 0 then [ws] else [] end) as sh from w),
size as (select doc_id, count(*) as k from s group by doc_id),
rare as (select sh from s group by sh having count(*) > 1),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join rare using (sh) join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
link as (select u, v from shared join size a on a.doc_id = u join size b on b.doc_id = v where 100 * shared.k >= {percent} * (a.k + b.k - shared.k)),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.v from reach r join link l on l.u = r.other)
select doc_id, coalesce(k, 0) :: bigint as n_shingles, least(doc_id, min(other)) as component_id, doc_id = least(doc_id, min(other)) as kept
from reach left join size using (doc_id) group by doc_id, k
"""
