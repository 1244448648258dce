"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import WORD, fresh, stage

HASH_BITS = 48
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, text: Column) -> Column:
    """48 hash bits of id and text: the same on every run and engine, and equal only for copies of a whole row."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources in code point order, null last, take the weights in turn and share the words of all. A target stops at ``most`` times
    its source's words and the excess goes to the others by weight. With the sources in order of cap / weight, the level that
    fills the budget is the largest of (budget - caps before) / (weights from here on); each target is min(cap, level * weight).
    The table has a row per source, not per document: its two windows are as large as the catalogue of sources.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by_source = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    line = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    leveled = by_source.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    level = F.max("level").over(everything)
    return leveled.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def source_plan(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, edge, edge_in``.

    ``sized`` has ``source, size, hash``. Every document is taken ``whole`` times; for the rest of the budget all documents with a
    hash below ``edge`` once more, and those at ``edge`` if ``edge_in``. Thresholds of smaller budgets nest in those of larger
    ones. Each level sums words by source and the next 12 hash bits, keeps the buckets that fit whole and goes on within the one
    bucket that holds the boundary; no document is sorted. After the last level that bucket is a single hash, which joins if
    that brings the sum nearer to the budget (a tie leaves it out). Sources without words have target 0 and no edge.
    """
    state = (source_targets(sized, weights, most)
             .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
             .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("bigint")).withColumn("base", F.lit(0).cast("bigint")))
    rows = sized.where("size > 0")
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = stage(state, "mix-state")
        known = state.select(F.col("source").alias("s"), "prefix", "base", "rest")
        inside = rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", low + LEVEL_BITS) == F.col("prefix")))
        hist = inside.groupBy("s", "base", "rest", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("words"))
        reach = F.sum("words").over(Window.partitionBy("s", "base", "rest").orderBy("bucket"))
        edge = (hist.withColumn("reach", F.col("base") + reach).where(F.col("reach") > F.col("rest"))
                .groupBy(F.col("s")).agg(F.min(F.struct("bucket", "reach", "words")).alias("e")))
        old = state.drop("prefix", "base", *(["last"] if "last" in state.columns else []))
        state = (old.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
                 .select(*old.columns, F.col("e.bucket").alias("prefix"), (F.col("e.reach") - F.col("e.words")).alias("base"), F.col("e.words").alias("last")))
    nearer = F.col("base") + F.col("last") - F.col("rest") < F.col("rest") - F.col("base")
    return stage(state.select("source", "source_size", "target", "whole", F.col("prefix").alias("edge"), nearer.alias("edge_in"), "rest"), "mix-plan")


def copies(hash_: Column) -> Column:
    """How often a row of a source plan takes a document. Without an edge, the rest of the budget is above all words left (or 0)."""
    below = F.when(F.col("edge").isNull(), F.col("rest") > 0).otherwise((hash_ < F.col("edge")) | ((hash_ == F.col("edge")) & F.col("edge_in")))
    return F.col("whole") + below.cast("bigint")


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Null texts and texts without words have size 0 and are taken with 0 words. A null source is a source of its own, last in
    order. Rows equal in id and text are taken equally often. An empty table gives an empty result. Other columns are ignored.
    """
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                              draw(F.col(doc_id), F.col(text)).alias("hash")), "mix-sizes")
    plan = source_plan(sized, weights, most).withColumnRenamed("source", "s")
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"))).alias("taken"), "source"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Texts without words are taken as often as their source is taken whole. A null source is a source of its own, null ids and texts are hashed as
    empty. Rows equal in id and text have one hash: a threshold takes or leaves them together. An empty table stays empty.
    """
    names = docs.columns
    sized = stage(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                              draw(F.col(doc_id), F.col(text)).alias("hash")), "mix-sizes")
    plan = source_plan(sized, weights, most)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source).alias("s"), draw(F.col(doc_id), F.col(text)).alias("hash"))
    joined = packed.join(plan, F.col("s").eqNullSafe(F.col("source")))
    times = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies(F.col("hash")).cast("int"))))
    return times.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


#: DuckDB text of :func:`mixed_sizes` with the default weights; {documents} is the table.
MIX_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) :: bigint as size,
         ('0x' || substr(md5(coalesce(doc_id :: varchar, '') || ':' || coalesce(text, '')), 1, 12)) :: bigint as hash
  from {documents}),
src as (
  select source, sum(size) :: bigint as source_size, 1.0 :: double + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sized group by source),
lev as (
  select *, source_size * 3.0 :: double as cap from src),
lev2 as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from lev),
tgt as (
  select source, source_size, least(cap, max(level) over () * weight) as target from lev2),
plan as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
         target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as rest from tgt),
grp as (
  select source, hash, sum(size) as words from sized where size > 0 group by source, hash),
cum as (
  select source, hash, words, sum(words) over (partition by source order by hash) as reach from grp),
edge as (
  select c.source, min(c.hash) as edge, min_by(c.reach - c.words, c.hash) as base, min_by(c.words, c.hash) as words
  from cum c join plan p on c.source is not distinct from p.source where c.reach > p.rest group by c.source)
select s.doc_id, s.size, p.source_size, p.target :: double as target, s.source,
  (s.size * (p.whole + case when e.edge is null then (p.rest > 0) :: int
     when s.hash < e.edge or (s.hash = e.edge and e.base + e.words - p.rest < p.rest - e.base) then 1 else 0 end)) :: bigint as taken
from sized s join plan p on s.source is not distinct from p.source
left join edge e on s.source is not distinct from e.source
"""
