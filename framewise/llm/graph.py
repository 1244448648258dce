"""Connected components of an edge table, as joins and combinable aggregates over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (long): root is the same for all nodes that are connected.

    Each round lets every node follow its smallest neighbour if that is smaller, shortens the chains, and replaces nodes by
    what they followed; edges within one root vanish. It ends when no edge is left. A hub's edges are only ever reduced with
    min() or joined to one row per node, so that Spark combines and splits them.
    """
    left = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    root: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to")), "follow")
        step = up.select(F.col("u").alias("to"), F.col("to").alias("next"))
        twice = up.join(step, "to").select("u", F.col("next").alias("to")).join(step, "to")
        up = stage(twice.select("u", F.col("next").alias("to")), "follow")
        if root is None:
            root = up.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            step = up.select(F.col("u").alias("root"), "to")
            root = root.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        root = stage(root, "roots")
        a, b = up.select("u", F.col("to").alias("a")), up.select(F.col("u").alias("v"), F.col("to").alias("b"))
        met = left.join(a, "u").join(b, "v").where("a <> b")
        left = stage(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if root is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root
