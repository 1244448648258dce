"""Ordered operators: change scores, islands, timelines, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise import scale
from framewise.functions import vectors as V


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def change_score(frames: DataFrame, keys: Sequence[str], ordinal: str = "frame", sig: str = "sig",
                 distance=V.mean_abs_distance) -> DataFrame:
    """Distance of every frame to the one before; null on the first frame."""
    with_previous = scale.previous(frames, keys, ordinal, {"__sig": sig})
    return with_previous.withColumn("change", distance(F.col("__sig"), F.col(sig))).drop("__sig")


def merge_false_cuts(shots: DataFrame, keys: Sequence[str], ordinal: str = "shot_idx") -> DataFrame:
    """Join neighbouring shots whose cut is only a camera shake.

    Needs per shot the match across its own start: inlier, tx, ty, scale, content.
    """
    same = ((F.col("inlier") >= 0.6) & (F.abs("tx") < 0.08) & (F.abs("ty") < 0.08)
            & F.col("scale").between(0.92, 1.08) & (F.col("content") <= 8.0))
    flagged = shots.withColumn("__new", F.when((F.col(ordinal) > 0) & same, 0).otherwise(1))
    islands = scale.running_sum(flagged, keys, ordinal, {"island": F.col("__new")})
    return (islands.groupBy(*keys, "island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                 (F.count(F.lit(1)) - 1).alias("merged")))


def merge_edge_fragments(shots: DataFrame, keys: Sequence[str], min_seconds: float,
                         ordinal: str = "shot_idx") -> DataFrame:
    """Short pieces at the end, then at the start, join their neighbour; one shot always stays."""
    length = F.col("end") - F.col("start")
    before = scale.running_sum(shots, keys, ordinal, {"__before": length}, inclusive=False)
    totals = shots.groupBy(*keys).agg(F.sum(length).alias("__total"))
    joined = before.join(totals, list(keys))
    after = F.col("__total") - F.col("__before") - length
    # time before the first shot of the tail piece, per key
    tail = joined.where(after < min_seconds).groupBy(*keys).agg(F.min("__before").alias("__tail"))
    placed = joined.join(tail, list(keys), "left")
    in_tail = after < min_seconds
    unit_before = F.when(in_tail, F.col("__tail")).otherwise(F.col("__before"))
    unit = (F.when(unit_before < min_seconds, F.lit(-1)).when(in_tail, F.lit(2 ** 62))
            .otherwise(F.col(ordinal)).cast("bigint"))
    return (placed.withColumn("__unit", unit).groupBy(*keys, "__unit")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                 (F.count(F.lit(1)) - 1).alias("merged")).drop("__unit"))


def drop_short_shots(shots: DataFrame, videos: DataFrame, keys: Sequence[str], shortest: float = 0.05) -> DataFrame:
    """Drop shots of at most ``shortest`` seconds; a video left without shots becomes one shot."""
    kept = shots.where(F.col("end") - F.col("start") > shortest).select(*keys, "start", "end")
    whole = videos.select(*keys, F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return kept.unionByName(whole.join(kept.select(*keys).distinct(), list(keys), "left_anti"))


def sample_times(shots: DataFrame, samples: int = 4, motion_samples: int = 8) -> DataFrame:
    """Evenly spaced sample times inside each shot, for people and for background motion."""
    length = F.col("end") - F.col("start")
    margin = F.least(length * 0.1, F.lit(0.25))

    def spaced(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
            i.alias("sample"), (F.col("start") + margin + (length - 2 * margin) * (i / (n - 1))).alias("time")))

    middle = F.array(F.struct(F.lit(0).alias("sample"), (F.col("start") + length / 2).alias("time")))
    people = F.when(length > 0.4, spaced(samples)).otherwise(middle) if samples > 1 else middle
    motion = F.when(length > 0.8, spaced(motion_samples)).otherwise(F.array().cast("array<struct<sample:int,time:double>>"))
    kinds = F.array(F.struct(F.lit("people").alias("kind"), people.alias("s")),
                    F.struct(F.lit("motion").alias("kind"), motion.alias("s")))
    out = shots.withColumn("__k", F.explode(kinds)).withColumn("__s", F.explode("__k.s"))
    return out.select(*shots.columns, F.col("__k.kind").alias("kind"), F.col("__s.sample").alias("sample"),
                      F.col("__s.time").alias("time"))


def frame_budget(starts: DataFrame, keys: Sequence[str], frames: str, budget: int) -> DataFrame:
    """Frames to look at: shot starts, then middles, then ends, until the budget is spent.

    ``starts`` holds the distinct start frames (column ``start_frame``) with the
    frame count of the video in ``frames``.  More starts than budget are thinned evenly.
    """
    numbered = scale.ordinal(starts, keys, ["start_frame"], "__i", block=F.floor(F.col("start_frame") / scale.SPAN))
    counts = starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    s = scale.following(numbered, keys, "__i", {"__next": "start_frame"}).join(counts, list(keys))
    s = s.withColumn("__end", F.coalesce(F.greatest(F.col("start_frame"), F.col("__next") - 1), F.col(frames) - 1))
    many = F.col("__n") > budget
    step = max(1, budget - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)),
                        lambda i: half_up(i * (F.col("__n") - 1) / step))
    thinned = s.where(many & F.array_contains(picks, F.col("__i"))).select(*keys, F.col("start_frame").alias("frame"))
    options = F.array(*[F.struct(F.lit(p).alias("p"), f.cast("bigint").alias("frame")) for p, f in enumerate(
        [F.col("start_frame"), half_up((F.col("start_frame") + F.col("__end")) * 0.5), F.col("__end")])])
    cand = s.where(~many).select(*keys, "__i", F.explode(options).alias("__o"))
    first = cand.groupBy(*keys, F.col("__o.frame").alias("frame")).agg(F.min(F.struct("__o.p", "__i")).alias("__rank"))
    spent = Window.partitionBy(*keys).orderBy("__rank")
    filled = first.withColumn("__rn", F.row_number().over(spent)).where(F.col("__rn") <= budget)
    return thinned.unionByName(filled.select(*keys, "frame"))


def timeline_layout(shots: DataFrame, keys: Sequence[str], duration: str, fps: float,
                    ordinal: str = "shot_idx") -> DataFrame:
    """Whole-frame positions of consecutive shots, at least one frame each."""
    length = F.greatest(F.lit(1), half_up(F.col(duration) * fps)).cast("bigint")
    out = scale.running_sum(shots, keys, ordinal, {"start_frame": length}, inclusive=False)
    return out.withColumn("end_frame", F.col("start_frame") + length)


CHANNELS = ["x", "y", "z", "roll", "pitch", "yaw"]


def keyframe_expand(shots: DataFrame) -> DataFrame:
    """Camera keys of each shot: first and last frame, jitter keys for handheld, lens keys for zooms.

    Needs start_frame, end_frame, motion, lens0, lens1 and ``<c>0`` / ``<c>1`` per channel.
    """
    last = F.greatest(F.col("start_frame"), F.col("end_frame") - 1)
    zoom = F.col("motion").isin("zoom_in", "zoom_out")

    def edge(frame: Column, end: int) -> Column:
        return F.struct(frame.cast("bigint").alias("frame"), *[F.col(f"{c}{end}").alias(c) for c in CHANNELS],
                        F.when(zoom, F.col(f"lens{end}")).alias("lens"))

    # Jitter of the handheld keys per channel (wave, phase factor, size).
    waves = {"x": (F.sin, 1.0, 3.5), "y": (F.cos, 1.31, 5.0), "z": (F.sin, 0.83, 2.5),
             "pitch": (F.sin, 1.47, 0.7), "yaw": (F.cos, 0.91, 1.1), "roll": (F.sin, 1.73, 0.45)}

    def shaken(i: int) -> Column:
        a = i / 6.0
        frame = half_up(F.col("start_frame") + (F.col("end_frame") - 1 - F.col("start_frame")) * a)
        def at(c: str) -> Column:
            wave, factor, size = waves[c]
            return F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * a + wave(F.lit(i * 2.17 * factor)) * size
        return F.struct(frame.cast("bigint").alias("frame"), *[at(c).alias(c) for c in CHANNELS],
                        F.lit(None).cast("double").alias("lens"))

    edges = F.array(edge(F.col("start_frame"), 0), edge(last, 1))
    shaky = (F.col("motion") == "handheld") & (F.col("end_frame") - F.col("start_frame") >= 6)
    keys = F.when(shaky, F.concat(edges, F.array(*[shaken(i) for i in range(1, 6)]))).otherwise(edges)
    used = {f"{c}{e}" for c in [*CHANNELS, "lens"] for e in (0, 1)} | {"start_frame", "end_frame", "motion"}
    ids = [c for c in shots.columns if c not in used]
    return shots.select(*ids, F.inline(keys))


def rebase_time(shots: DataFrame, keys: Sequence[str], ordinal: str = "shot_idx") -> DataFrame:
    """Times relative to the first shot of the segment, to the millisecond."""
    origin = shots.groupBy(*keys).agg(F.min_by("start", ordinal).alias("origin"))
    joined = shots.join(origin, list(keys))
    return joined.withColumns({c: F.round(F.col(c) - F.col("origin"), 3) for c in ("start", "end")})


def people_rank(people: DataFrame, sample: Sequence[str], height: str, score: str, tie: str, top: int = 4) -> DataFrame:
    """Largest sure people first; the first is the main person, the rest in depth order."""
    strength = F.col(height) * F.least(F.lit(1.0), F.col(score) / 0.6)
    w = Window.partitionBy(*sample).orderBy(strength.desc(), F.col(tie))
    ranked = people.withColumn("depth_order", F.row_number().over(w) - 1)
    role = F.when(F.col("depth_order") == 0, "main_character").otherwise(
        F.concat(F.lit("character_"), F.col("depth_order") + 1))
    return ranked.where(F.col("depth_order") < top).withColumn("role", role)


def reversals(series: DataFrame, keys: Sequence[str], axis: str, ordinal: str = "i", floor: float = 0.004) -> DataFrame:
    """Sign flips between neighbouring steps that are both larger than ``floor``."""
    steps = scale.previous(series, keys, ordinal, {"__p": axis})
    flip = (F.col("__p") * F.col(axis) < 0) & (F.abs("__p") > floor) & (F.abs(axis) > floor)
    return steps.groupBy(*keys).agg(F.count_if(F.coalesce(flip, F.lit(False))).alias("reversals"))


def pick_best_format(formats: DataFrame, keys: Sequence[str], max_short_side: int) -> DataFrame:
    """Best track per video: readable codec, then size, avc, one file, bitrate, id."""
    codec = F.lower(F.coalesce("vcodec", F.lit("")))
    short = F.least("width", "height")
    avc = codec.rlike("^(avc|h264)")
    rank = F.struct(codec.rlike("^(avc|h264|vp9|vp09)").alias("readable"), short.alias("short_side"), avc.alias("avc"),
                    (~F.coalesce("protocol", F.lit("")).contains("m3u8")).alias("progressive"),
                    F.coalesce("tbr", F.lit(0.0)).alias("tbr"), F.col("format_id").cast("string").alias("format_id"))
    usable = (~codec.isin("", "none")) & (F.col("width") > 0) & (F.col("height") > 0) & (short <= max_short_side)
    return formats.where(usable).groupBy(*keys).agg(F.max(rank).alias("__b")).select(*keys, "__b.format_id", "__b.short_side")


def review_top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], show: int = 5) -> DataFrame:
    """First flagged rows per group and how many more there are.

    Each map task keeps only its best rows per group, so a large group never meets in one task.
    """
    flagged = rows.where("needs_review")
    hidden = flagged.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - show, F.lit(0)).alias("hidden"))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    w = Window.partitionBy(*keys).orderBy(*order)
    salted = flagged.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(64)))
    few = salted.withColumn("__rn", F.row_number().over(local)).where(F.col("__rn") <= show).drop("__rn", "__salt")
    best = few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= show)
    return best.join(hidden, list(keys))


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias("first_at"))
