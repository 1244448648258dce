from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from framewise.operators import boundaries as BD
from framewise.operators import windows as W
from framewise import staging
from framewise.sources import tables as ST
from framewise.streaming import jobs


def frame_rows(n=60, seed=4):
    rng = np.random.default_rng(seed)
    return [(v, float(f), [float(x) for x in rng.random(8)]) for v in (1, 2) for f in range(n)]


FRAMES = "v int, time double, sig array<double>"


def drain(spark, folder, name, delay, closing=1e6):
    """Run a stream of boundaries over the files of ``folder``/in, one a micro-batch, then close it."""
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream = jobs.stream_boundaries(jobs.with_closings(stream, f"{folder}/{name}"), ["v"], 0.3, 4.0, delay)
    path = jobs.run_to_table(stream, f"{folder}/{name}", "b")
    jobs.close(spark, f"{folder}/{name}", closing)
    assert jobs.run_to_table(stream, f"{folder}/{name}", "b") == path
    return spark.read.schema("v int, time double, score double, kind string").parquet(path).collect()


def batch_boundaries(spark, rows):
    df = spark.createDataFrame(rows, FRAMES).withColumn("frame", F.col("time").cast("bigint"))
    return sorted((r["v"], r["time"]) for r in BD.detect_boundaries(W.change_score(df, ["v"]), ["v"], 0.3, 4.0).collect())


def test_shuffled_stream_equals_batch_and_late_frames_are_counted(spark, tmp_path):
    rows = frame_rows()
    mixed = [rows[i] for i in np.random.default_rng(2).permutation(len(rows))]
    # frames up to 30 seconds late: four files of 30 seconds, the frames of any two neighbours mixed
    order = sorted(mixed, key=lambda r: r[1] // 15 + (hash(r[:2]) % 2))
    for part in range(4):
        spark.createDataFrame(order[part * 30 : part * 30 + 30], FRAMES).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    late = [(1, 3.5, [9.0] * 8), (2, 7.25, [9.0] * 8), (1, 58.5, [0.5] * 8)]
    spark.createDataFrame(late, FRAMES).coalesce(1).write.parquet(str(tmp_path / "in" / "p9"))
    got = drain(spark, str(tmp_path), "out", delay=40.0)
    # the newest frame is at 59 seconds: what is behind second 19 is late, 58.5 is not
    assert sorted((r["v"], r["time"]) for r in got if r["kind"] == "late") == [(1, 3.5), (2, 7.25)] and all(r["score"] is None for r in got if r["kind"] == "late")
    frames = [(v, t, s) for v, t, s in rows if v == 2]
    assert sorted((r["v"], r["time"]) for r in got if r["kind"] == "boundary" and r["v"] == 2) == batch_boundaries(spark, frames)
    assert any(r["v"] == 1 and r["kind"] == "boundary" for r in got)


def test_stream_waits_for_what_is_not_closed(spark, tmp_path):
    rows = [(1, float(t), [float(t % 2)] * 4) for t in range(12)]
    spark.createDataFrame(rows[6:], FRAMES).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    spark.createDataFrame(rows[:6], FRAMES).coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    got = drain(spark, str(tmp_path), "half", delay=100.0, closing=5.0)
    assert got == []  # second 5 less the delay: all frames still wait
    got = drain(spark, str(tmp_path), "whole", delay=100.0)
    assert sorted((r["v"], r["time"]) for r in got) == [(1, 0.0), (1, 4.0), (1, 8.0)]


def test_index_follows_listings(spark, tmp_path):
    seen = []

    def analyse(df):
        seen.append(sorted(r["path"] for r in df.collect()))
        return df.withColumn("n", F.length("fingerprint"))

    index = jobs.IncrementalIndex(str(tmp_path), "path", "fingerprint", analyse, buckets=4)
    listing = lambda rows: spark.createDataFrame(rows, "path string, fingerprint string")
    index.merge(listing([("a", "1"), ("b", "1"), ("c", "1")]), 1)
    first = index.places(spark, 1)
    seen.clear()
    index.merge(listing([("a", "1"), ("b", "22"), ("d", "1")]), 5)
    schema = "path string, fingerprint string, n int"
    assert sorted(map(tuple, index.read(spark, schema).collect())) == [("a", "1", 1), ("b", "22", 2), ("d", "1", 1)]
    assert sorted(map(tuple, index.read(spark, schema, 1).collect())) == [("a", "1", 1), ("b", "1", 1), ("c", "1", 1)]
    assert ["b", "d"] in seen and index.newest(spark) == 5
    # nothing changed: no bucket is written again
    before = index.places(spark, 5)
    index.merge(listing([("a", "1"), ("b", "22"), ("d", "1")]), 6)
    assert index.places(spark, 6) == before and set(first) <= {0, 1, 2, 3}
    index.merge(listing([]), 7)
    assert index.read(spark, schema).collect() == [] and index.newest(spark) == 7


def test_listings_of_many_files_and_a_restart_without_news(spark, tmp_path):
    schema = "path bigint, fingerprint string, closes bigint, listing bigint"

    def drop(number, rows, closes):
        full = [(p, f, None, number) for p, f in rows] + ([(None, None, closes, number)] if closes is not None else [])
        spark.createDataFrame(full, schema).repartition(5).write.parquet(str(tmp_path / "drops" / f"{number}-{closes}"))

    def run():
        index = jobs.IncrementalIndex(str(tmp_path / "index"), "path", "fingerprint", lambda df: df.select("path", "fingerprint"), buckets=3)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "drops" / "*"))
        version = index.run(stream)
        return version, sorted(map(tuple, index.read(spark, "path bigint, fingerprint string").collect()))

    one, two = [(i, "x") for i in range(40)], [(i, "y" if i % 4 == 0 else "x") for i in range(5, 50)]
    drop(1, one, 40)
    drop(2, two[:20], None)  # the rest of this listing isn't there yet
    assert run() == (1, one)
    assert run() == (1, one)  # nothing new
    drop(2, two[20:], 45)
    assert run() == (2, two)


def test_index_is_dealt_before_it_is_written(spark, tmp_path):
    """The rows of a bucket, kept and new ones, meet in one task, in place of the tasks of all file splits and joins before."""
    index = jobs.IncrementalIndex(str(tmp_path), "path", "fingerprint", lambda df: df.select("path", "fingerprint"), buckets=2)
    listing = lambda n, mark: spark.range(0, n, 1, 5).select(F.col("id").alias("path"), F.concat(F.lit(mark), F.col("id") % 3).alias("fingerprint"))
    index.merge(listing(100, "a"), 1)
    index.merge(listing(150, "a"), 2)
    assert index.read(spark, "path bigint, fingerprint string").count() == 150
    assert [len(list(Path(p).glob("part-*"))) for p in index.places(spark, 2).values()] == [1, 1]
    index.step(listing(400, "b").select(F.lit(3).alias("listing"), "path", "fingerprint", F.lit(None).cast("bigint").alias("closes")), 0)
    assert len(list((tmp_path / "pending" / "batch=0" / "listing=3").glob("part-*"))) == 1


def test_reports_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("x", True, False)], "name string, measured boolean, needs_review boolean")
    path = str(tmp_path / "q")
    a, b = ST.write_quality_report(rows, path), ST.write_quality_report(rows, path)
    assert a != b and spark.read.parquet(path).count() == 2


def test_index_is_rewritten_and_versioned(spark, tmp_path):
    entries = spark.createDataFrame([("v1.mp4", 3)], "path string, n_shots int")
    failures = spark.createDataFrame([("bad.mp4", "broken")], "path string, error string")
    for _ in range(2):
        ST.write_library_index(entries, failures, str(tmp_path), "a:1")
    back = ST.read_library_index(spark, str(tmp_path), "path string, n_shots int, version int, analyzer string")
    assert [tuple(r) for r in back.collect()] == [("v1.mp4", 3, 1, "a:1")]


def test_media_scan(spark, tmp_path):
    for name in ("a.mp4", "sub/B.MOV", "note.txt", f"{ST.INDEX_FOLDER}/plans/c.mp4"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    df = ST.scan_media(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in df.collect()) == ["B.MOV", "a.mp4"]
    assert "content" not in df.columns


def test_shared_folder_comes_from_the_session(tmp_path):
    class Session:
        def __init__(self, shared, master):
            self.conf = type("C", (), {"get": staticmethod(lambda key, default=None: shared if key == staging.DIR_CONF else default)})
            self.sparkContext = type("S", (), {"master": master, "applicationId": "app"})

    assert jobs.work_folder(Session(str(tmp_path), "spark://x")).startswith(str(tmp_path))
    for master in ("spark://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            jobs.work_folder(Session(None, master))


def test_staged_tables_can_be_released(spark):
    import os

    made = staging.stage(spark.range(5).toDF("a"))
    folder = staging.shared_folder(spark)
    assert made.count() == 5 and os.listdir(folder)
    staging.release(spark)
    assert not os.path.exists(folder)
    assert staging.stage(spark.range(3).toDF("a")).count() == 3


def test_stream_of_boundaries_reads_a_folder_of_parts(spark, tmp_path):
    run = lambda sf: sorted(map(tuple, queries()["st1_stream_boundaries"](spark, sf).collect()))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = run("/root/testdata/sf0.001")
    assert want and run(str(tmp_path)) == want
