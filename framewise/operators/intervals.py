"""Questions about intervals without tables of pairs.

Ends and points of a key are put in one order, and everything after works on ranks.  Which interval that holds a point comes first in some order
is a minimum over a segment tree: ranks are cut into blocks, an interval that covers whole blocks leaves its rank order at the O(log) nodes of a
tree over blocks, and inside a block a small tree answers all points at once.  Which interval inside another is the longest is a running
maximum per node of a tree over starts.  A key of any size spreads over its blocks and nodes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise import scale
from framewise.operators import kernels as N
from framewise.staging import stage

BLOCK = 4096


def ranked(parts: Mapping[str, tuple[DataFrame, str, int]], keys: Sequence[str], bin_seconds: float) -> DataFrame:
    """(keys, what, id, rank): places of all ends and points of a key in the order of time.

    ``parts`` maps a name to (rows with ``id``, time column, order among equal times).  ``bin_seconds`` cuts the time of a large key
    into pieces that are put in order apart.  Rows without a time have no rank.
    """
    rows = None
    for what, (df, time, at) in parts.items():
        one = df.select(*keys, F.lit(what).alias("what"), F.lit(at).alias("at"), F.col("id"), F.col(time).cast("double").alias("time"))
        rows = one if rows is None else rows.unionByName(one)
    placed = scale.ordinal(rows.where("time IS NOT NULL"), keys, ["time", "at", "what", "id"], "rank", block=F.floor(F.col("time") / bin_seconds))
    return placed.select(*keys, "what", "id", "rank")


def _up(x: Column, levels: Column) -> Column:
    return F.call_function("shiftright", x, levels.cast("int"))


def _down(x: Column, levels: Column) -> Column:
    return F.call_function("shiftleft", x, levels.cast("int"))


def _levels(last: Column) -> Column:
    """Levels of a binary tree at which a range that ends before block ``last`` may have nodes."""
    return F.sequence(F.lit(0), F.floor(F.log2(F.greatest(last, F.lit(1)))).cast("int"))


def first_holding(points: DataFrame, intervals: DataFrame, keys: Sequence[str], order: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Per point the interval that holds it and comes first by the numbers in ``order``: (keys, id, order); points that none holds are left out.

    points: (keys, id, rank); intervals: (keys, lo, hi, order), ranks of both ends.
    """
    keys, order = list(keys), list(order)
    first, last = F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)
    i = intervals.where("lo < hi").withColumns({"b0": first, "b1": last})
    piece = lambda b, lo, hi: F.struct(b.alias("block"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    head, tail, end = F.col("lo") % block, F.col("hi") % block, F.lit(block - 1)
    ends = F.when(first == last, F.array(piece(F.col("b0"), head, tail))).otherwise(F.array(
        piece(F.col("b0"), head, end), piece(F.col("b1"), F.lit(0), tail)))
    pieces = i.select(*keys, *order, F.inline(ends))

    def nodes(level: Column) -> Column:
        low, high = _up(F.col("b0") + _down(F.lit(1).cast("bigint"), level), level), _up(F.col("b1"), level)
        node = lambda test, at: F.when((low < high) & test, F.struct(level.alias("level"), at.alias("node")))
        return F.array(node(low % 2 == 1, low), node(high % 2 == 1, high - 1))

    whole = i.where(F.col("b1") - F.col("b0") > 1).select(*keys, *order, F.inline(F.array_compact(F.flatten(F.transform(_levels(F.col("b1")), nodes)))))
    held = whole.groupBy(*keys, "level", "node").agg(F.min(F.struct(*order)).alias("best"))
    asked = points.select(*keys, "id", F.floor(F.col("rank") / block).alias("block"), (F.col("rank") % block).cast("int").alias("lo"))
    above = F.transform(_levels(F.col("block")), lambda level: F.struct(level.alias("level"), _up(F.col("block"), level).alias("node")))
    blocks = asked.select(*keys, "block").where("block > 0").distinct().select(*keys, "block", F.inline(above))
    carried = blocks.join(held, [*keys, "level", "node"]).groupBy(*keys, "block").agg(F.min("best").alias("best"))
    pieces = pieces.unionByName(carried.select(*keys, "block", F.lit(0).alias("lo"), end.alias("hi"), "best.*"))
    rows = pieces.unionByName(asked, allowMissingColumns=True)
    fields = ", ".join(f"`{c}` {t}" for c, t in [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name in [*keys, "id", *order]])
    dealt = rows.repartition(*keys, "block").sortWithinPartitions(*keys, "block")
    return dealt.mapInPandas(N.hold_points(keys, order, block), fields).select(*keys, "id", *order)


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, point_id: str, interval_id: str,
                      bin_seconds: float, block: int = BLOCK) -> DataFrame:
    """Interval of the smallest id that holds the point (both ends included); points without one are kept.  Ids are numbers, unique per key."""
    keys = list(keys)
    p, i = points.select(*keys, F.col(point_id).alias("id"), point), intervals.select(*keys, F.col(interval_id).alias("id"), "start", "end")
    at = stage(ranked({"start": (i, "start", 0), "point": (p, point, 1), "end": (i, "end", 2)}, keys, bin_seconds), "ranks")
    spans = at.where("what <> 'point'").groupBy(*keys, "id").agg(
        F.max(F.when(F.col("what") == "start", F.col("rank"))).alias("lo"), F.max(F.when(F.col("what") == "end", F.col("rank"))).alias("hi"))
    found = first_holding(at.where("what = 'point'"), spans.withColumnRenamed("id", interval_id), keys, [interval_id], block)
    return points.join(found.withColumnRenamed("id", point_id), [*keys, point_id], "left")


def _longest_inside(truth: DataFrame, cands: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Per truth the longest candidate inside it (ties: earlier start, larger id): (keys, tid, best).

    A candidate stands at every node above its start.  The starts after a truth's start are O(log) nodes; at each of them the answer is the
    largest of the candidates that end before the truth does, a running maximum in the order of ends.
    """
    one = F.lit(1).cast("bigint")
    most = cands.groupBy(*keys).agg(F.max("lo").alias("most"))

    def after(v: Column) -> Column:
        node = _up(F.col("lo") + _down(one, v), v)
        return F.when((node % 2 == 1) & (_down(node, v) <= F.col("most")), F.struct(v.alias("level"), node.alias("node")))

    best = F.struct("length", "early", "cid")
    # only levels at which some truth of the key may ask
    reach = F.floor(F.log2(F.greatest(F.col("most"), F.lit(1)))).cast("int")
    above = F.transform(F.sequence(F.lit(0), reach), lambda v: F.struct(v.alias("level"), _up(F.col("lo"), v).alias("node")))
    c = cands.join(most, keys).select(*keys, F.col("hi").alias("rank"), best.alias("best"), F.lit(None).cast("bigint").alias("tid"), F.inline(above))
    t = truth.join(most, keys).select(*keys, F.col("hi").alias("rank"), F.lit(None).cast(c.schema["best"].dataType).alias("best"), "tid",
                                      F.inline(F.array_compact(F.transform(F.sequence(F.lit(0), reach), after))))
    lines = c.unionByName(t)
    seen = scale.running_max(lines, [*keys, "level", "node"], "rank", "best", "most", span).where("tid IS NOT NULL AND most IS NOT NULL")
    return seen.groupBy(*keys, "tid").agg(F.max("most").alias("best"))


def best_overlap(truth: DataFrame, candidates: DataFrame, keys: Sequence[str], truth_id: str, cand_id: str, bin_seconds: float,
                 block: int = BLOCK, span: int = scale.SPAN) -> DataFrame:
    """For every truth interval the candidate with the largest overlap; the earliest start wins ties, then the larger id.

    A candidate that overlaps a truth holds its end, holds its start, or lies inside it.  The earliest that holds the end wins if it holds
    the start too; else the best is this one, the one that holds the start and ends last, or the longest inside.  Ids are numbers (below 2**53), unique per key.
    """
    keys = list(keys)
    # both sides are read by several passes
    truth, candidates = stage(truth, "truth-rows"), stage(candidates, "candidate-rows")
    t = truth.select(*keys, F.col(truth_id).cast("bigint").alias("id"), "start", "end")
    c = candidates.select(*keys, F.col(cand_id).cast("bigint").alias("id"), "start", "end")
    # at equal times: a truth's end, candidates' ends and starts, a truth's start
    at = stage(ranked({"t1": (t, "end", 0), "c0": (c, "start", 1), "c1": (c, "end", 2), "t0": (t, "start", 3)}, keys, bin_seconds), "ranks")
    place = lambda what: F.max(F.when(F.col("what") == what, F.col("rank")))
    spans = lambda a, b: at.where(F.col("what").isin(a, b)).groupBy(*keys, "id").agg(place(a).alias("lo"), place(b).alias("hi"))
    cs = stage(c.join(spans("c0", "c1"), [*keys, "id"]).select(
        *keys, "lo", "hi", F.col("start").cast("double").alias("early"), (-F.col("end").cast("double")).alias("late"), (-F.col("id")).alias("other")), "candidates")
    ts = stage(t.join(spans("t0", "t1"), [*keys, "id"]).where("lo < hi").select(*keys, F.col("id").alias("tid"), "lo", "hi", "start", "end"), "truths")
    # both questions in one pass: who holds the end and starts first, who holds the start and ends last
    orders = {"end": ("hi", ("early", "other", "late")), "start": ("lo", ("late", "early", "other"))}
    asked = ts.select(*keys, F.col("tid").alias("id"), F.inline(F.array(*[F.struct(F.lit(q).alias("ask"), F.col(rank).alias("rank")) for q, (rank, _) in orders.items()])))
    turned = cs.select(*keys, "lo", "hi", F.inline(F.array(*[F.struct(F.lit(q).alias("ask"), *[F.col(c).cast("double").alias(f"o{k}") for k, c in enumerate(order)])
                                                             for q, (_, order) in orders.items()])))
    holding = first_holding(asked, turned, [*keys, "ask"], ["o0", "o1", "o2"], block)
    place = lambda c: F.when(F.col("ask") == "end", F.col(f"o{orders['end'][1].index(c)}")).otherwise(F.col(f"o{orders['start'][1].index(c)}"))
    held = holding.select(*keys, F.col("id").alias("tid"), place("early").alias("c0"), (-place("late")).alias("c1"), (-place("other")).cast("bigint").alias("cid"))
    length = (-F.col("late") - F.col("early")).alias("length")
    inside = _longest_inside(ts, cs.where("lo < hi").select(*keys, "lo", "hi", length, (-F.col("early")).alias("early"), (-F.col("other")).alias("cid")), keys, span)
    held = held.unionByName(inside.select(*keys, "tid", (-F.col("best.early")).alias("c0"), (F.col("best.length") - F.col("best.early")).alias("c1"), "best.cid"))
    shared = F.least("end", "c1") - F.greatest("start", "c0")
    best = held.join(ts, [*keys, "tid"]).withColumn("overlap", shared).where("overlap > 0").groupBy(*keys, "tid").agg(
        F.max(F.struct("overlap", (-F.col("c0")).alias("n0"), F.col("cid").alias("id"))).alias("b"))
    found = best.select(*keys, F.col("tid").alias(truth_id), F.col("b.id").alias(cand_id), F.col("b.overlap").alias("overlap"))
    return truth.join(found, [*keys, truth_id], "left")
