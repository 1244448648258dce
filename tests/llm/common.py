"""Small tables with every awkward case, and plain versions of shared rules."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = "stone river cloud ember quiet lantern harbor willow copper meadow signal orchard velvet thunder pebble canyon".split()
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns that clash with names used inside the operators
    *[T.StructField(c, T.StringType()) for c in ("key", "size", "hash", "row", "h", "c", "n", "kept", "_kept", "_key", "_clean", "_raw", "score", "s", "edge", "copy", "KEPT_SHA", "ids", "doc")],
])


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:2] for _ in range(n))


def edge_rows() -> list[tuple]:
    texts = [
        (1, prose(1, 90)), (2, prose(1, 90)), (2, prose(1, 90)), (None, prose(2, 70)), (None, prose(2, 70)), (None, None), (3, None), (4, ""), (5, " \n\t "),
        (6, prose(6, 20_000)), (7, "x" * 40_000), (8, "日本語 テキスト🙂 é ▁ \u0000 a@b.co 10.0.0.1 +1 555 123 4567"), (9, "one"), (10, prose(1, 89) + " changed"),
        (2**60 + 1, prose(3, 80)), (2**60 + 2, prose(3, 80)), (11, "a b c d\na b c d\na b c d\n" * 40), (-5, "### *** $$$ " * 60)]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *["x" if k % 2 else None] * (len(SCHEMA) - 5))
            for k, (i, t) in enumerate(texts)]


def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
