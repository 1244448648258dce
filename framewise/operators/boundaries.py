"""Shot boundaries with a minimum distance to the last accepted one.

Whether a candidate is accepted depends on the last accepted one, so a video is
a chain.  The chain is cut into pieces: every piece tabulates, for each candidate
that could be its first accepted one, which acceptance the piece ends with; the
tables (one row per piece) are folded per video; then all pieces replay their
chain in parallel from the known state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise import scale
from framewise.operators import kernels as N


def detect_boundaries(scored: DataFrame, keys: Sequence[str], threshold: float, min_gap: float,
                      ordinal: str = "frame", time: str = "time", score: str = "change",
                      span: int = scale.SPAN) -> DataFrame:
    """Rows (keys, ordinal, time, score) of the accepted boundaries; the first frame always is one."""
    keys = list(keys)
    first = F.col(ordinal) == 0
    cand = scored.where(first | (F.col(score) >= threshold)).select(
        *keys, F.col(ordinal).cast("bigint").alias("o"), F.col(time).cast("double").alias("t"),
        F.when(first, F.lit(1.0)).otherwise(F.col(score)).alias("s"))
    found = _pieced(cand, keys, min_gap, span)
    return found.select(*keys, F.col("o").alias(ordinal), F.col("t").alias(time), F.col("s").alias("score"))


def _pieced(cand: DataFrame, keys: list[str], min_gap: float, span: int) -> DataFrame:
    key_fields = [cand.schema[k] for k in keys]
    pieces = cand.withColumn("piece", F.floor(F.col("o") / span))
    tables = pieces.groupBy(*keys, "piece").applyInPandas(
        N.chain_table(keys, min_gap),
        T.StructType([*key_fields, T.StructField("piece", T.LongType()),
                      T.StructField("heads", T.ArrayType(T.DoubleType())),
                      T.StructField("exits", T.ArrayType(T.DoubleType()))]))
    entries = tables.groupBy(*keys).applyInPandas(
        N.chain_entries(keys, min_gap),
        T.StructType([*key_fields, T.StructField("piece", T.LongType()), T.StructField("entry", T.DoubleType())]))
    fields = ["o", "t", "s"]
    return pieces.join(entries, [*keys, "piece"]).groupBy(*keys, "piece").applyInPandas(
        N.chain_replay(keys, min_gap),
        T.StructType([*key_fields, *[cand.schema[f] for f in fields]]))
