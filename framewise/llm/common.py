"""Helpers shared by the corpus operators: the shared folder, staged tables and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run of characters that are not ASCII white space. ``bytes.split()`` on UTF-8 is the same rule.
WORD = r"[^\x20\x09-\x0D]+"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local[...] session may do without: it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_folders.setdefault(app, tempfile.mkdtemp(prefix="framewise-"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/framewise-llm/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits of id and text. Rows that share it are copies in both and have the same result, so it may stand for a row."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
         "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def slices(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` rows, so that a task holds the lists of few rows at once."""
    for b in batches:
        for a in range(0, b.num_rows, most or max(1, b.num_rows)):
            yield b.slice(a, most)


def map_batches(rows: DataFrame, fn: Callable[..., Sequence], columns: dict[str, str], reads: Sequence[str] = ("text",), most: int | None = None) -> DataFrame:
    """Add ``columns`` (name: type in ARROW) that ``fn`` makes from Arrow batches (of at most ``most`` rows) of the ``reads`` columns, given as lists.

    The other columns pass through untouched, so ids keep their type and nulls; the ``reads`` columns are dropped.
    """
    keep = [c for c in rows.columns if c not in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most):
            made = fn(*[b.column(c).to_pylist() for c in reads])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, ARROW[kind]) for x, kind in zip(made, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], [*keep, *columns])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` {k}" for c, k in columns.items())])
    return rows.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text is not None else b""


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit. Fixed multipliers of a public mixing function."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
