"""Rule sets that yield errors as rows, and filters of incoming records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import text as T
from framewise.scale import bind


def _outside(c: Column, low: float, high: float) -> Column:
    return ~c.between(low, high) | F.isnan(c)


def _document_rows(plans: DataFrame, ids: Sequence[str], plan_rules: dict[str, Column], shot_rules: Callable[[Column], tuple[dict, dict]]) -> DataFrame:
    """(ids, shot_idx, level, rule): what a plan and each of its shots break, all out of one row per plan; plan rows have a null shot_idx."""
    def found(at: Column, errors: dict[str, Column], warnings: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[
            F.when(test, F.struct(at.cast("bigint").alias("shot_idx"), F.lit(level).alias("level"), F.lit(rule).alias("rule")))
            for level, rules in (("error", errors), ("warning", warnings)) for rule, test in rules.items()]))

    shots = F.transform("shots", lambda s, i: found(i, *shot_rules(s)))
    return plans.select(*ids, F.inline(F.concat(found(F.lit(None), plan_rules, {}), F.flatten(shots))))


def validate_cinematic_plan(plans: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Range and dependency rules of camera plans (title, frame_rate, aspect_ratio, shots), in one pass over the documents."""
    p = bind(plans.select(*ids, "title", "frame_rate", "aspect_ratio", "shots"), n=F.size("shots"),
             total=F.aggregate("shots", F.lit(0.0), lambda t, s: t + s["duration_seconds"]))
    plan_rules = {
        "title": F.trim("title") == "", "frame_rate": ~F.col("frame_rate").between(1, 120),
        "aspect_ratio": _outside(F.col("aspect_ratio"), 0.25, 4.0), "no_shots": F.col("n") == 0, "too_many_shots": F.col("n") > 100,
        "total_duration": F.col("total") > 1800.0,
    }

    def shot_rules(s: Column) -> tuple[dict, dict]:
        none, at = s["subject"] == "", s["camera_location"]
        return {
            "name": F.trim(s["name"]) == "", "duration": ~s["duration_seconds"].between(0.1, 120.0),
            "focal_length": ~s["focal_length"].between(8.0, 200.0), "animation_subject": (s["animation_id"] != "") & none,
            "distance": ~s["distance_cm"].between(30.0, 10000.0),
            "offset": (F.abs(s["height_cm"]) > 5000.0) | (F.abs(s["side_cm"]) > 5000.0),
            "screen": ~(s["subject_screen_x"].between(0, 1) & s["subject_screen_y"].between(0, 1)),
            "focus_height": ~s["focus_height"].between(0, 1),
            "location": F.sqrt(sum((F.coalesce(at[a], F.lit(0.0)) ** 2 for a in "yz"), F.coalesce(at["x"], F.lit(0.0)) ** 2)) > 1000000.0,
            "lip_sync_subject": (s["lip_sync_animation_id"] != "") & none,
        }, {"dialogue_audio": (s["dialogue"] != "") & (s["audio_id"] == "")}

    return _document_rows(p, ids, plan_rules, shot_rules)


def validate_blocking(plans: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Second rule set, run before building: safe ranges, known motions, unique placements per shot."""
    p = bind(plans.select(*ids, "frame_rate", "aspect_ratio", "shots"), n=F.size("shots"))
    plan_rules = {"no_shots": F.col("n") == 0, "frame_rate": ~F.col("frame_rate").between(1, 120),
                  "aspect_ratio": _outside(F.col("aspect_ratio"), 0.25, 4.0)}
    still = lambda at, names: F.greatest(*[F.abs(F.coalesce(at[n], F.lit(0.0))) for n in names]) <= 1e-4

    def shot_rules(s: Column) -> tuple[dict, dict]:
        labels = F.transform(s["actor_placements"], lambda a: a["actor"])
        named = F.filter(labels, lambda x: x != "")
        return {
            "name": s["name"] == "", "duration": _outside(s["duration_seconds"], 0.1, 120.0),
            "focal_length": _outside(s["focal_length"], 8.0, 200.0), "distance": _outside(s["distance_cm"], 20.0, 10000.0),
            "origin": (s["subject"] == "") & still(s["camera_location"], "xyz") & still(s["camera_rotation"], ("pitch", "yaw", "roll")),
            "motion": ~s["camera_motion"].isin(["", *C.MOTIONS]),
            "placement_label": F.size(named) < F.size(labels), "placement_twice": F.size(F.array_distinct(named)) < F.size(named),
            "placement_nan": F.exists(s["actor_placements"], lambda a: F.isnan(a["location"]["x"]) | F.isnan(a["location"]["y"]) | F.isnan(a["location"]["z"])),
        }, {
            "zoom_limit": s["camera_motion"].isin("zoom_in", "zoom_out") & (s["focal_length"] >= 190.0),
            "look_at": (s["subject"] != "") & (s["look_at"] == ""),
        }

    return _document_rows(p, ids, plan_rules, shot_rules)


def media_file_error(path: Column, size: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./?#]+)$", 1))
    return (F.when(~extension.isin("mp4", "mov", "m4v", "avi"), "format")
            .when((size <= 0) | (size > 2 * 1024 ** 3), "size"))


def edge_side(x: Column, w: Column, h: Column, area: Column, frame_w: float, frame_h: float) -> Column:
    """Side a large foreground piece touches; the right side wins."""
    side = F.when(x + w >= frame_w - 3, "right").when(x <= 2, "left")
    return F.when((area >= 0.03 * frame_w * frame_h) & (h >= 0.3 * frame_h), side)


def is_cropped(left: Column, top: Column, right: Column, bottom: Column, height: Column, w: float, h: float) -> Column:
    edge = (left <= 4) | (top <= 4) | (right >= w - 4) | (bottom >= h - 4)
    return edge | (height > F.greatest(F.lit(1.0), bottom - top) * 1.05)


def clean_request(raw: Column) -> dict[str, Column]:
    """Only allowed values of an untrusted JSON request row survive."""
    v = F.try_parse_json(raw)

    def label(name: str, allowed: list[str]) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        value = F.lower(F.regexp_replace(F.try_variant_get(v, f"$.{name}", "string"), r"^\s+|\s+$", ""))
        return F.when((kind == "STRING") & value.isin(allowed), value)

    kind = F.schema_of_variant(F.try_variant_get(v, "$.people", "variant"))
    number = F.try_variant_get(v, "$.people", "double")
    people = F.when(kind.rlike("^(BIGINT|INT|DOUBLE|DECIMAL)") & (number >= 1) & (number < 4), number.cast("int"))
    ots = F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.ots", "variant")) == "BOOLEAN")
                     & F.try_variant_get(v, "$.ots", "boolean"), F.lit(False))
    return {"size": F.coalesce(label("size", C.SIZE_ORDER), F.when(ots, F.lit("medium"))),
            "angle": label("angle", C.ANGLES), "motion": label("motion", C.MOTIONS),
            "people": F.when(ots, F.lit(1)).otherwise(people), "ots": ots}


def flat_curves(curves: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keys of curves that stay at zero."""
    r = curves.groupBy(*keys).agg(F.max(value).alias("__hi"), F.min(value).alias("__lo"))
    return r.where((F.col("__hi") - F.col("__lo") < 1e-6) & (F.abs("__hi") < 1e-6)).select(*keys)


def prune_flat_curves(curves: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return curves.join(flat_curves(curves, keys, value), list(keys), "left_anti")


def low_confidence(shots: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Shots to look at: no person apart from low confidence, with the percentage shown."""
    empty = F.col("subject_role") == ""
    low = ~empty & (F.col("confidence") < threshold)
    return shots.where(empty | low).select(
        *keys, "name", F.when(empty, "no_person").otherwise("low_confidence").alias("flag"),
        F.when(low, F.floor(F.col("confidence") * 100 + 0.5)).alias("percent"))


def posture_guard(pairs: DataFrame, meshes: DataFrame) -> DataFrame:
    """Reason why a pair of meshes must not be matched; null when it may."""
    side = lambda s: meshes.select(*[F.col(c).alias(f"{s}_{c}") for c in meshes.columns])
    j = pairs.join(side("source"), "source_mesh", "left").join(side("target"), "target_mesh", "left")

    def weak(s: str) -> Column:
        return ~F.coalesce(F.col(f"{s}_overrides_valid"), F.lit(False)) | (F.coalesce(F.col(f"{s}_readiness"), F.lit(0.0)) < 0.70)

    reason = (F.when(weak("source"), "source").when(weak("target"), "target")
              .when(F.col("source_upright") != F.col("target_upright"), "posture"))
    return j.select(*pairs.columns, reason.alias("reason"))


def referential_integrity(shots: DataFrame, animations: DataFrame, subjects: DataFrame, sounds: DataFrame) -> DataFrame:
    """First broken reference of each shot.

    Dimension rows are looked up by id; ids must be unique in the dimensions.
    """
    a = animations.select(F.col("animation_id"), F.col("skeleton").alias("__as"))
    lip = animations.select(F.col("animation_id").alias("lip_sync_id"), F.lit(True).alias("__lip"))
    s = subjects.select("subject", F.col("skeleton").alias("__ss"), F.lit(True).alias("__s"))
    d = sounds.select("audio_id", F.lit(True).alias("__d"))
    j = shots.join(a, "animation_id", "left").join(lip, "lip_sync_id", "left").join(s, "subject", "left").join(d, "audio_id", "left")
    animated = F.col("animation_id").isNotNull()
    reason = (F.when(animated & F.col("__s").isNull(), "subject").when(animated & F.col("__as").isNull(), "animation")
              .when(animated & (F.col("__as") != F.col("__ss")), "skeleton")
              .when(F.col("lip_sync_id").isNotNull() & F.col("__lip").isNull(), "lip_sync")
              .when(F.col("audio_id").isNotNull() & F.col("__d").isNull(), "audio"))
    return j.withColumn("reason", reason).drop("__as", "__ss", "__s", "__lip", "__d")


def expected_counts(produced: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Produced rows per combination against the wanted number; nothing produced is an error."""
    counts = produced.groupBy(*keys).agg(F.count(F.lit(1)).alias("produced"))
    j = expected.join(counts, list(keys), "left").withColumn("produced", F.coalesce("produced", F.lit(0)))
    return j.withColumn("status", F.when(F.col("produced") == 0, "missing").when(
        F.col("produced") != F.col("wanted"), "partial").otherwise("ok"))


def required_parts(parts: DataFrame, key: str, part: str, required: list[str]) -> DataFrame:
    """Relational division: which keys have every required part, and the first one missing."""
    have = parts.where(F.col(part).isin(required)).groupBy(key).agg(F.collect_set(part).alias("__have"))
    every = parts.select(key).distinct().join(have, key, "left")
    missing = F.filter(F.array(*[F.lit(r) for r in required]),
                       lambda r: ~F.array_contains(F.coalesce("__have", F.array().cast("array<string>")), r))
    return every.select(key, (F.size(missing) == 0).alias("valid"), F.get(missing, F.lit(0)).alias("first_missing"))


def url_rows(pages: DataFrame, url: str, domains: list[str]) -> DataFrame:
    return pages.withColumns(T.url_class(F.col(url), domains))
