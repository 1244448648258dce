"""Incremental jobs: shot boundaries as keyed state in event time, and an index that only analyses what changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import joins as J
from framewise.operators import kernels as N
from framewise.staging import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds that event times are moved by: a stream's first watermark is 0, and a frame at second 0 is not behind it.
OFFSET = 1000


def work_folder(spark: SparkSession) -> str:
    """A folder of its own for checkpoints and written tables, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"


def stream_boundaries(frames: DataFrame, keys: Sequence[str], threshold: float, min_gap: float, delay: float) -> DataFrame:
    """Boundaries of a stream of frames (keys, time in seconds from 0 on, sig), equal to the batch operator however the frames of the last
    ``delay`` seconds are shuffled over micro-batches.

    Frames wait in the state of their video until the watermark (the newest time of the stream less ``delay``) has passed them. Result rows
    (keys, time, score, kind) are boundaries or, for frames that come after that, late frames without a score, so none is lost
    unseen. A row without a signature closes the stream up to its time: it moves the watermark and is no frame.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    at = F.timestamp_millis(F.floor(F.col("time") * 1000) + OFFSET)
    # without the column of the watermark the late rows reach the operator, which counts them
    timed = frames.withColumn("__at", at).withWatermark("__at", f"{int(delay * 1000)} milliseconds").select(*keys, "time", "sig")
    return timed.groupBy(*keys).transformWithStateInPandas(
        N.BoundaryState(keys, threshold, min_gap, OFFSET), f"{kinds}, time double, score double, kind string", "append", "EventTime")


def with_closings(frames: DataFrame, folder: str) -> DataFrame:
    """``frames`` and the closing rows of ``folder`` in one stream."""
    spark = frames.sparkSession
    path = f"{folder}/closings"
    spark.createDataFrame([], "time double").write.mode("append").parquet(path)
    return frames.unionByName(spark.readStream.schema("time double").parquet(path), allowMissingColumns=True)


def close(spark: SparkSession, folder: str, time: float) -> None:
    """No frame up to ``time`` is still to come. The next run releases what waits."""
    spark.createDataFrame([(float(time),)], "time double").write.mode("append").parquet(f"{folder}/closings")


def run_to_table(stream: DataFrame, folder: str, name: str) -> str:
    """Drain a stream into a parquet table and return its path. Called again with the same folder and name it goes on where it ended."""
    path = f"{folder}/{name}"
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder}/{name}-checkpoint")
                 .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return path


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by ``columns`` to tasks of the advisory size. A write by folders sorts the rows of a task by folder, in memory: without this as
    many as a file split or the join before it holds."""
    return df.hint("rebalance", *map(F.col, columns))


class IncrementalIndex:
    """Index kept current by listings: each listing is complete, files missing from it leave.

    Listings come as a stream in any number of files and micro-batches: rows (listing, key, fingerprint, ...), and one row without a key
    whose ``closes`` is the number of rows of its listing. A listing is merged once all its rows are there; ids of listings increase. Rows of
    the index lie in ``buckets`` folders by hash of the key, a version is a manifest that names a folder for each bucket, and a merge
    writes only the buckets that hold a new, changed or removed file. Batches are written by number and versions by listing, so a
    repeated batch rewrites its own and a lost executor never leaves a half index.
    """

    def __init__(self, folder: str, key: str, fingerprint: str, analyse: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.folder, self.key, self.fingerprint, self.analyse, self.buckets = folder, key, fingerprint, analyse, buckets

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _there(self, spark: SparkSession, name: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def newest(self, spark: SparkSession) -> int | None:
        """Listing of the newest version in the folder."""
        if not self._there(spark, "manifest"):
            return None
        return spark.read.schema("bucket int, place string, version bigint").parquet(f"{self.folder}/manifest").agg(F.max("version")).first()[0]

    def places(self, spark: SparkSession, version: int) -> dict[int, str]:
        """Folder of each bucket; at most ``buckets`` rows."""
        rows = spark.read.schema("bucket int, place string").parquet(f"{self.folder}/manifest/version={version}").collect()
        return {r.bucket: r.place for r in rows if r.place}

    def read(self, spark: SparkSession, schema: str, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The index as of ``version`` (the newest); ``only`` some of its buckets."""
        version = self.newest(spark) if version is None else version
        places = {} if version is None else self.places(spark, version)
        paths = [p for b, p in sorted(places.items()) if only is None or b in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, listing: DataFrame, version: int) -> None:
        spark = listing.sparkSession
        made = self.analyse(listing)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        old = self.newest(spark)
        places = {} if old is None else self.places(spark, old)
        known = self.read(spark, schema, old).select(self.key, self.fingerprint, F.lit(True).alias("has_plan"))
        states = J.cache_join(listing, known, self.key, self.fingerprint).where("state <> 'cached'").withColumn("bucket", self._bucket())
        states.write.mode("overwrite").parquet(f"{self.folder}/states/version={version}")
        states = spark.read.schema(states.schema).parquet(f"{self.folder}/states/version={version}")
        touched = {r.bucket for r in states.select("bucket").distinct().collect()}  # at most one per bucket
        todo = self.analyse(listing.join(states.where("state IN ('new', 'changed')").select(self.key), self.key, "left_semi"))
        kept = self.read(spark, schema, old, touched).join(states.select(self.key), self.key, "left_anti")
        data = f"{self.folder}/data/version={version}"
        _dealt(kept.unionByName(todo).withColumn("bucket", self._bucket()), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        full = {b for b in touched if self._there(spark, f"data/version={version}/bucket={b}")}
        places = {b: p for b, p in places.items() if b not in touched} | {b: f"{data}/bucket={b}" for b in full}
        rows = sorted(places.items()) or [(0, None)]
        spark.createDataFrame(rows, "bucket int, place string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def step(self, df: DataFrame, batch: int) -> None:
        """Keep the rows of a micro-batch and merge the listings that are complete now, oldest first."""
        spark, pending = df.sparkSession, f"{self.folder}/pending"
        _dealt(df, "listing", self.key).write.mode("overwrite").partitionBy("listing").parquet(f"{pending}/batch={batch}")
        newest = self.newest(spark)
        rows = spark.read.option("basePath", pending).schema(df.schema).parquet(pending).where(F.col("listing") > (-1 if newest is None else newest))
        counted = rows.groupBy("listing").agg(F.count(self.key).alias("n"), F.max("closes").alias("closes"))
        for r in counted.where("n = closes").orderBy("listing").collect():  # a row per open listing
            self.merge(rows.where((F.col("listing") == r.listing) & F.col(self.key).isNotNull()).drop("listing", "closes"), r.listing)

    def run(self, listings: DataFrame) -> int | None:
        """Drain a stream of listings; returns the newest version, also when nothing new came."""
        query = (listings.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/index-checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return self.newest(listings.sparkSession)
