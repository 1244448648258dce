"""Skew-safe building blocks shared by the operators.

A key may hold a large share of all rows.  The work of one key is therefore cut
into blocks, each block is reduced on its own, and only the block summaries meet
per key.  Numbers and quantiles count the rows of each key first: keys that are all
small stay whole, without the shuffles of blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.staging import stage

SPAN = 65536
BUCKETS = 1024
SMALL = 4096


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    Later filters and projections then read the computed value.  With a plain
    projection the optimizer may push a filter below it and evaluate an expensive
    expression (a JSON parse, a camera matrix) once per reference.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
            block: Column | None = None, span: int = SPAN) -> DataFrame:
    """Dense 0-based row number per key.

    ``block`` is an expression that never decreases along ``order``.  If a key has more than
    ``span`` rows (they are counted first), it cuts keys into pieces that are numbered apart and
    shifted by the row counts of the earlier pieces; rows without a block come first.  Without it a key must be bounded.
    """
    if block is None or df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > span).isEmpty():
        # rows stay together by key, so later steps on it need no shuffle
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    cut = df.withColumn("__block", F.coalesce(block.cast("bigint"), F.lit(-(2**62))))
    counts = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    same = [*keys, "__block"]
    offsets = counts.select(*[F.col(c).alias(f"__at{i}") for i, c in enumerate(same)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*same).orderBy(*order)
    numbered = cut.withColumn("__rn", F.row_number().over(inner) - 1)
    return (numbered.join(offsets, [F.col(c).eqNullSafe(F.col(f"__at{i}")) for i, c in enumerate(same)])
            .withColumn(name, (F.col("__rn") + F.col("__off")).cast("bigint"))
            .drop("__block", "__rn", "__off", *[f"__at{i}" for i in range(len(same))]))


def previous(df: DataFrame, keys: Sequence[str], ordinal_col: str, columns: Mapping[str, str],
             span: int = SPAN) -> DataFrame:
    """``lag(1)`` along a dense ordinal.

    The window key holds at most ``span + 1`` rows: a key is cut every ``span``
    ordinals and the last row of a piece is also sent to the next piece.
    """
    piece = F.floor(F.col(ordinal_col) / span)
    edge = (F.col(ordinal_col) % span) == span - 1
    spread = df.withColumn("__piece", F.explode(
        F.when(edge, F.array(piece, piece + 1)).otherwise(F.array(piece))))
    w = Window.partitionBy(*keys, "__piece").orderBy(ordinal_col)
    return (spread.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
            .where(F.col("__piece") == piece).drop("__piece"))


def following(df: DataFrame, keys: Sequence[str], ordinal_col: str, columns: Mapping[str, str],
              span: int = SPAN) -> DataFrame:
    """``lead(1)`` along a dense ordinal; the first row of a piece is also sent to the piece before."""
    piece = F.floor(F.col(ordinal_col) / span)
    edge = (F.col(ordinal_col) % span) == 0
    spread = df.withColumn("__piece", F.explode(
        F.when(edge, F.array(piece, piece - 1)).otherwise(F.array(piece))))
    w = Window.partitionBy(*keys, "__piece").orderBy(ordinal_col)
    return (spread.withColumns({new: F.lead(old).over(w) for new, old in columns.items()})
            .where(F.col("__piece") == piece).drop("__piece"))


def running_sum(df: DataFrame, keys: Sequence[str], ordinal_col: str, sums: Mapping[str, Column],
                inclusive: bool = True, span: int = SPAN) -> DataFrame:
    """Running totals along an ordinal; large keys add up piece totals first."""
    last = 0 if inclusive else -1
    cut = df.withColumn("__piece", F.floor(F.col(ordinal_col) / span))
    totals = cut.groupBy(*keys, "__piece").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__piece", *[
        F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums])
    inner = Window.partitionBy(*keys, "__piece").orderBy(ordinal_col).rowsBetween(Window.unboundedPreceding, last)
    local = cut.withColumns({f"__l_{n}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    return (local.join(carried, [*keys, "__piece"])
            .withColumns({n: F.col(f"__l_{n}") + F.col(f"__c_{n}") for n in sums})
            .drop("__piece", *[f"__l_{n}" for n in sums], *[f"__c_{n}" for n in sums]))


def running_max(df: DataFrame, keys: Sequence[str], ordinal_col: str, column: str, name: str, span: int = SPAN) -> DataFrame:
    """Largest value up to each row along an ordinal, nulls passed over; large keys meet by the largest value of each piece."""
    cut = df.withColumn("__piece", F.floor(F.col(ordinal_col) / span))
    tops = cut.groupBy(*keys, "__piece").agg(F.max(column).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "__piece", F.max("__t").over(before).alias("__c"))
    inner = Window.partitionBy(*keys, "__piece").orderBy(ordinal_col).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__l", F.max(column).over(inner))
    return local.join(carried, [*keys, "__piece"]).withColumn(name, F.greatest("__l", "__c")).drop("__piece", "__l", "__c")


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]],
              accuracy: int = 10000, upper: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one row per key; those named in ``upper`` are the value at the higher rank.

    ``wanted`` maps an output name to (column, probability).  Groups of at most ``small`` rows put their values in order in one row each.
    Larger ones go through the same passes, stacked as (name, value).  ``percentile_approx``
    gives brackets around the rank, which are staged: its summaries depend on the order in which
    they merge, so all readers must see the same ones, and the small table is broadcast where it
    fits, so rows don't travel to their key.  The rows below a bracket are counted, the distinct values
    inside are counted by value, the bracket is cut into BUCKETS equal parts, and only the values of the parts that
    hold the rank are put in order, so no task ever holds a whole group.  A merged summary may miss its rank by more than
    1/accuracy; groups whose bracket did so go through a wider one, at last from the smallest to the largest value.
    """
    group = list(keys) or ["__all"]
    keyed = df if keys else df.withColumn("__all", F.lit(1))
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    few, many = sizes.agg(F.count_if(F.col("__rows") <= small), F.count_if(F.col("__rows") > small)).first()
    if not many:
        out = _of_small(keyed, group, wanted, upper)
    elif not few:
        out = _of_large(keyed, group, wanted, accuracy, upper)
    else:
        # at most one in ``small`` rows is such a group
        large = F.broadcast(stage(sizes.where(F.col("__rows") > small).select(*[F.col(c).alias(f"__at{i}") for i, c in enumerate(group)]), "large"))
        same = [F.col(c).eqNullSafe(F.col(f"__at{i}")) for i, c in enumerate(group)]
        out = _of_small(keyed.join(large, same, "left_anti"), group, wanted, upper).unionByName(
            _of_large(keyed.join(large, same, "left_semi"), group, wanted, accuracy, upper))
    return out if keys else out.drop("__all")


def _between(v0: Column, v1: Column, frac: Column, upper: Column) -> Column:
    return F.when(upper, v1).when(frac == 0, v0).otherwise(v0 * (1 - frac) + v1 * frac)


def _of_small(df: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str, float]], upper: Sequence[str]) -> DataFrame:
    """Quantiles of groups whose values fit in a row."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    held = df.groupBy(*group).agg(*[F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(f"__v{i}") for i, c in enumerate(columns)])

    def at(name: str) -> Column:
        column, p = wanted[name]
        values = F.col(f"__v{columns.index(column)}")
        rank = F.lit(float(p)) * (F.size(values) - 1)
        place = lambda r: F.get(values, r.cast("int"))
        return _between(place(F.floor(rank)), place(F.ceil(rank)), rank - F.floor(rank), F.lit(name in upper))

    return held.select(*group, *[at(n).alias(n) for n in wanted])


def _of_large(keyed: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str, float]], accuracy: int, upper: Sequence[str]) -> DataFrame:
    """Quantiles of groups of any size, by brackets."""
    probabilities = sorted({p for _, p in wanted.values()})
    stacked = keyed.select(*group, F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("x"), F.lit(float(p)).alias("p"))
        for n, (c, p) in wanted.items()])).alias("__q"))
    rows = stacked.select(*group, F.col("__q.name").alias("__name"), F.col("__q.x").alias("__x"), F.col("__q.p").alias("__p"))
    per = [*group, "__name"]

    # half widths of the brackets; a group starts with the narrowest one that spans at least three ranks on each side
    slacks = [2.0 / accuracy]
    while slacks[-1] < 1.0:
        slacks.append(min(1.0, slacks[-1] * 10))
    ends = [e for p in probabilities for s in slacks for e in (max(0.0, p - s), min(1.0, p + s))]
    bracket = rows.groupBy(*per).agg(
        F.count("__x").alias("__n"), F.max("__p").alias("__p"), F.percentile_approx("__x", ends, accuracy).alias("__b"),
        F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    width = F.lit(len(slacks) - 1)
    for i in range(len(slacks) - 2, -1, -1):
        width = F.when(F.col("__n") * slacks[i] >= 3, i).otherwise(width)
    which = F.lit(0)
    for i, p in enumerate(probabilities):
        which = F.when(F.col("__p") == p, i).otherwise(which)
    rank = F.col("__p") * (F.col("__n") - 1)
    bracket = stage(bracket.withColumn("__w", width), "brackets").select(
        *per, "__n", "__b", "__min", "__max", "__w", (which * len(slacks)).alias("__at"),
        F.floor(rank).alias("__k0"), F.ceil(rank).alias("__k1"), (rank - F.floor(rank)).alias("__frac"))
    solved = stage(_at_ranks(rows, bracket, per, 0, len(slacks) - 1), "quantiles")
    for wider in range(1, len(slacks)):
        missed = solved.where("__missed")
        if missed.isEmpty():
            break
        again = _at_ranks(rows, bracket.join(missed.select(*per), per, "left_semi"), per, wider, len(slacks) - 1)
        solved = stage(solved.where("NOT __missed").unionByName(again), "quantiles")
    value = _between(F.col("__v0"), F.col("__v1"), F.col("__frac"), F.col("__name").isin(list(upper)))
    value = F.when(F.col("__missed"), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(value)
    return solved.groupBy(*group).agg(*[F.max(F.when(F.col("__name") == n, value)).alias(n) for n in wanted])


def _at_ranks(rows: DataFrame, bracket: DataFrame, per: Sequence[str], wider: int, widest: int) -> DataFrame:
    """Values at the two ranks of each group of ``bracket`` and whether its bracket, ``wider`` steps above its first, missed one."""
    step = F.least(F.col("__w") + wider, F.lit(widest))
    start = ((F.col("__at") + step) * 2).cast("int")
    whole = step == widest
    limits = bracket.select(*per, "__n", "__k0", "__k1", "__frac", F.when(whole, F.col("__min")).otherwise(F.get("__b", start)).alias("__lo"),
                            F.when(whole, F.col("__max")).otherwise(F.get("__b", start + 1)).alias("__hi"))
    x = F.col("__x")
    # values inside the bracket by part, and one part -1 that counts the rows below; never null, so that both readers share one exchange
    part = F.when(x < F.col("__lo"), -1).when(F.col("__hi") > F.col("__lo"), F.coalesce(F.floor(
        (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BUCKETS), F.lit(0))).otherwise(0)
    counted = (rows.drop("__p").where(x.isNotNull()).join(limits, per).where(x <= F.col("__hi"))
               .groupBy(*per, part.alias("__part"), F.when(x >= F.col("__lo"), x).alias("__v"))
               .agg(F.count(F.lit(1)).alias("__c"), F.first("__k0").alias("__k0"), F.first("__k1").alias("__k1")))
    parts = counted.groupBy(*per, "__part").agg(F.sum("__c").alias("__c"), F.first("__k0").alias("__k0"), F.first("__k1").alias("__k1"))
    along = Window.partitionBy(*per).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    reached = parts.withColumn("__end", F.sum("__c").over(along)).withColumn("__base", F.col("__end") - F.col("__c"))
    holds = ((F.col("__base") <= F.col("__k0")) & (F.col("__k0") < F.col("__end"))) | (
        (F.col("__base") <= F.col("__k1")) & (F.col("__k1") < F.col("__end")))
    inside = counted.join(reached.where(holds).select(*per, "__part", "__base"), [*per, "__part"])
    order = Window.partitionBy(*per, "__part").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("__e", F.col("__base") + F.sum("__c").over(order)).withColumn("__s", F.col("__e") - F.col("__c"))

    def at(k: str) -> Column:
        return F.max(F.when((F.col("__s") <= F.col(k)) & (F.col(k) < F.col("__e")), F.col("__v")))

    found = ranked.groupBy(*per).agg(at("__k0").alias("__v0"), at("__k1").alias("__v1"))
    missed = (F.col("__n") > 0) & (F.col("__v0").isNull() | F.col("__v1").isNull())
    return limits.select(*per, "__n", "__frac").join(found, per, "left").select(*per, "__frac", "__v0", "__v1", missed.alias("__missed"))
