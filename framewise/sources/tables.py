"""Listings, pose and curve documents, link analyses, and the sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Video extensions.
VIDEO_EXTENSIONS = ["mp4", "mov", "mkv", "webm", "avi", "m4v"]
INDEX_FOLDER = ".framewise"
INDEX_VERSION = 1


def media_listing(files: DataFrame, path: str = "path") -> DataFrame:
    """Videos of a listing: allowed extensions in any case, nothing below the index folder."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    hidden = F.concat(F.lit("/"), F.col(path)).contains(f"/{INDEX_FOLDER}/")
    return files.where(extension.isin(VIDEO_EXTENSIONS) & ~hidden)


def scan_media(spark: SparkSession, library: str) -> DataFrame:
    """Recursive listing of a library; file contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(library)
             .select("path", "length", "modificationTime"))
    return media_listing(files)


def latest_dataset(folders: DataFrame, patterns: Sequence[str], dataset: str = "dataset", path: str = "path") -> DataFrame:
    """Newest folder of each dataset: the first pattern with any match, then the last name in order.

    ``{dataset}`` in a pattern stands for the literal name of the row's dataset.
    """
    rank = F.lit(None).cast("int")
    quoted = F.concat(F.lit("\\Q"), F.col(dataset), F.lit("\\E"))
    for i, pattern in reversed(list(enumerate(patterns))):
        parts = pattern.split("{dataset}")
        said = F.concat(*[x for k, p in enumerate(parts) for x in ([quoted] if k else []) + [F.lit(p)]])
        rank = F.when(F.regexp_like(path, said), i).otherwise(rank)
    best = folders.withColumn("__r", rank).where("__r IS NOT NULL").groupBy(dataset, "__r").agg(F.max(path).alias(path))
    return best.groupBy(dataset).agg(F.min_by(path, "__r").alias(path))


POSE_SCHEMA = ("struct<name:string,source_frames:array<struct<time:double,bones:map<string,array<double>>,twist:map<string,array<double>>>>,"
               "target_frames:array<struct<time:double,bones:map<string,array<double>>,twist:map<string,array<double>>>>>")


def read_pose_pairs(docs: DataFrame, text: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Pose pair documents as long rows: poses (pair, side, sample, role, x, y, z) and twists (.., q)."""
    p = docs.select(F.from_json(text, POSE_SCHEMA).alias("p"))
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("p.source_frames").alias("f")), F.struct(F.lit("t").alias("side"), F.col("p.target_frames").alias("f")))
    f = p.select(F.col("p.name").alias("pair"), F.inline(sides)).select("pair", "side", F.posexplode("f").alias("sample", "f"))
    keys = ["pair", "side", F.col("sample").cast("bigint").alias("sample")]
    v = lambda i: F.get("v", F.lit(i))
    poses = f.select(*keys, F.explode("f.bones").alias("role", "v")).select("pair", "side", "sample", "role", *[v(i).alias(c) for i, c in enumerate("xyz")])
    twists = f.select(*keys, F.explode("f.twist").alias("role", "q"))
    return poses, twists


CURVE_SCHEMA = "struct<performance:string,frame_rate:double,curve_names:array<string>,values:array<map<string,double>>>"


def read_curve_tables(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Sparse curve documents as a dense long table: a curve without a key in a frame is 0."""
    c = docs.select(F.from_json(text, CURVE_SCHEMA).alias("c"))
    f = c.select(F.col("c.performance").alias("name"), F.col("c.frame_rate").alias("fps"), F.col("c.curve_names").alias("names"),
                 F.posexplode("c.values").alias("frame", "m"))
    g = f.select("name", "frame", "fps", "m", F.explode("names").alias("curve"))
    return g.select("name", F.col("frame").cast("bigint").alias("frame"), (F.col("frame") / F.col("fps")).alias("time"), "curve",
                    F.coalesce(F.element_at("m", F.col("curve")), F.lit(0.0)).alias("value"))


def read_link_analyses(plans: DataFrame, sources: DataFrame) -> DataFrame:
    """Analyses made from links: both documents of a folder must parse and hold at least one shot.

    plans / sources: (folder, doc).
    """
    v = lambda df, n: df.select("folder", F.try_parse_json("doc").alias(n)).where(F.col(n).isNotNull())
    j = v(plans, "p").join(v(sources, "s"), "folder")
    text = lambda c, n: F.nullif(F.try_variant_get(c, f"$.{n}", "string"), F.lit(""))
    shots = F.size(F.try_variant_get("p", "$.shots", "array<variant>"))
    title = F.trim(F.coalesce(text("s", "title"), text("p", "title"), "folder"))
    return j.where(shots > 0).select(
        "folder", F.concat(F.lit("link:"), title).alias("path"), title.alias("title"), F.coalesce(text("s", "url"), F.lit("")).alias("url"), shots.alias("n_shots"),
        F.try_variant_get("p", "$.analysis_notes.identities.count", "int").alias("identities"),
        F.coalesce(F.try_variant_get("s", "$.video_retained", "boolean"), F.lit(False)).alias("video_retained"))


def write_quality_report(rows: DataFrame, path: str, run_id: str | None = None) -> str:
    """Append one run; earlier runs are never replaced.  Returns the run id."""
    run = run_id or uuid.uuid4().hex
    rows.withColumns({"run_id": F.lit(run), "created": F.current_timestamp()}).write.mode("append").partitionBy("run_id").parquet(path)
    return run


def report_header(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of a report: rows, measured, to review."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if("measured").alias("measured"), F.count_if("needs_review").alias("review"))


def library_index(entries: DataFrame, analyzer: str) -> DataFrame:
    return entries.withColumns({"version": F.lit(INDEX_VERSION), "analyzer": F.lit(analyzer)})


def write_library_index(entries: DataFrame, failures: DataFrame, path: str, analyzer: str) -> None:
    """Full rewrite of the index and its failures."""
    library_index(entries, analyzer).write.mode("overwrite").json(f"{path}/videos")
    failures.write.mode("overwrite").json(f"{path}/failures")


def read_library_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of the current version; an index of another version counts as empty."""
    return spark.read.schema(schema).json(f"{path}/videos").where(F.col("version") == INDEX_VERSION)


def shot_line(ordinal: Column) -> Column:
    """One preview line of a reference shot."""
    return F.format_string(
        "%02d  %.2f-%.2fs  %s | role=%s | %s / %s / %s | confidence %.0f%%", ordinal + 1, "start_seconds", "end_seconds", "name", "subject_role",
        "shot_size", "camera_angle", "camera_motion", F.floor(F.col("confidence") * 100 + 0.5).cast("double"))


def verify_line() -> Column:
    """One line of a comparison report: the status, or score and errors."""
    ok = F.format_string("%s: score %.0f | dx %+.3f dy %+.3f | size x%.2f", "name", "score", "error_x", "error_y", "height_ratio")
    return F.when(F.col("status") == "ok", ok).otherwise(F.concat_ws(": ", "name", "status"))


def quality_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """One sentence a group on a quality report: how many pairs were measured, are to be reviewed and could not be measured."""
    h = report_header(rows, *keys)
    text = F.format_string("Quality check: %d of %d measured need a review", "review", "measured")
    missing = F.when(F.col("rows") > F.col("measured"), F.format_string(" (%d could not be measured for missing roles)", F.col("rows") - F.col("measured"))).otherwise("")
    return h.select(*keys, F.concat(text, missing).alias("text"))


def context_text(scenes: DataFrame, rows: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """What a scene offers as a text: its lines in order, ``none`` for a scene without any (a scene holds a few hundred things)."""
    listed = rows.where(F.col(line).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("__l"))
    return scenes.join(listed, list(keys), "left").select(*keys, F.coalesce(F.array_join("__l", "\n"), F.lit("none")).alias("text"))


def actor_line(label: Column, kind: Column, x: Column, y: Column, z: Column) -> Column:
    return F.format_string("- label=%s; class=%s; location=(%.1f,%.1f,%.1f)", label, kind, x, y, z)


def asset_line(name_id: Column, kind: Column, name: Column, seconds: Column) -> Column:
    return F.format_string("- id=%s; type=%s; name=%s; duration=%.2fs", name_id, kind, name, seconds)
