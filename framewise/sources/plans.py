"""Plan and report documents: strict parsing with defaults, and the JSON written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions.shot import clamp
from framewise.scale import bind

XY = "struct<x:double,y:double>"
WH = "struct<width:double,height:double>"
AMOUNT = "struct<screen_dx:double,screen_dy:double,background_scale:double,subject_scale:double,path:double,steps:int>"
REFERENCE_SCHEMA = (
    "struct<schema_version:double,title:string,match_mode:string,vision_model:string,analysis_fingerprint:string,"
    "aspect_ratio:double,shots:array<struct<name:string,subject_role:string,start_seconds:double,end_seconds:double,"
    f"shot_size:string,camera_angle:string,camera_motion:string,camera_motion_amount:{AMOUNT},composition:string,"
    f"confidence:double,subject_screen_position:{XY},subject_screen_size:{WH},"
    f"subjects:array<struct<role:string,screen_position:{XY},screen_size:{WH},depth_order:double>>,"
    "over_the_shoulder:struct<side:string,screen_x:double,screen_width:double>>>,broken:string>")
CINEMATIC_SCHEMA = (
    "struct<title:string,frame_rate:double,aspect_ratio:double,shots:array<struct<name:string,description:string,"
    "subject:string,look_at:string,animation_id:string,audio_id:string,speaker:string,dialogue:string,"
    f"lip_sync_animation_id:string,camera_motion:string,camera_motion_amount:{AMOUNT},duration_seconds:double,"
    "focal_length:double,distance_cm:double,height_cm:double,side_cm:double,camera_roll:double,"
    "subject_screen_x:double,subject_screen_y:double,focus_height:double,"
    "camera_location:struct<x:double,y:double,z:double>,camera_rotation:struct<pitch:double,yaw:double,roll:double>,"
    "actor_placements:array<struct<actor:string,location:struct<x:double,y:double,z:double>,"
    "rotation:struct<pitch:double,yaw:double,roll:double>>>,"
    "over_shoulder:struct<actor:string,side:string,edge_x:double>>>,broken:string>")
REPORT_SCHEMA = (
    "struct<overall_score:double,summary:string,shots:array<struct<composition_score:double,"
    "subject_position_score:double,shot_size_score:double,camera_angle_score:double>>,broken:string>")
MAX_SHOTS = 120


def _parse(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def _amount(a: Column) -> Column:
    scale = F.coalesce(a["background_scale"], F.lit(1.0))
    return F.when(a.isNotNull(), F.struct(
        F.coalesce(a["screen_dx"], F.lit(0.0)).alias("screen_dx"), F.coalesce(a["screen_dy"], F.lit(0.0)).alias("screen_dy"),
        F.when(scale > 0, scale).otherwise(F.lit(1.0)).alias("background_scale"),
        F.when(a["subject_scale"] > 0, a["subject_scale"]).alias("subject_scale"),
        F.coalesce(a["path"], F.lit(0.0)).alias("path"),
        F.greatest(F.lit(1), F.coalesce(a["steps"], F.lit(1))).alias("steps")))


def _xy(p: Column) -> Column:
    return F.struct(F.coalesce(p["x"], F.lit(0.5)).alias("x"), F.coalesce(p["y"], F.lit(0.5)).alias("y"))


def _wh(p: Column, width: float) -> Column:
    return F.struct(F.coalesce(p["width"], F.lit(width)).alias("width"), F.coalesce(p["height"], F.lit(0.5)).alias("height"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with one evaluation of the value; inside a lambda equal expressions are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_reference_plans(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Parse reference plan documents.

    Adds title, match_mode, aspect_ratio, shots (defaults filled) and ``error``:
    the first reason a document is refused, null when it is accepted.
    """
    p = F.col("__p")
    version = F.floor(F.coalesce(p["schema_version"], F.lit(1.0)) + 0.5)
    mode = F.coalesce(p["match_mode"], F.lit("scene"))

    def shot(s: Column) -> Column:
        people = F.filter(F.transform(F.coalesce(s["subjects"], F.array()), lambda q: F.struct(
            _text(q["role"]).alias("role"), _xy(q["screen_position"]).alias("screen_position"),
            _wh(q["screen_size"], 0.25).alias("screen_size"),
            F.floor(F.coalesce(q["depth_order"], F.lit(0.0)) + 0.5).cast("int").alias("depth_order"))),
            lambda q: (q["role"] != "") & q["screen_position"]["x"].between(0, 1) & q["screen_position"]["y"].between(0, 1))
        role, position, size = _text(s["subject_role"]), _xy(s["subject_screen_position"]), _wh(s["subject_screen_size"], 0.3)
        alone = F.array(F.struct(role.alias("role"), position.alias("screen_position"), size.alias("screen_size"),
                                 F.lit(0).alias("depth_order")))
        ots = s["over_the_shoulder"]
        return F.struct(
            _text(s["name"]).alias("name"), role.alias("subject_role"),
            F.coalesce(s["start_seconds"], F.lit(0.0)).alias("start_seconds"),
            F.coalesce(s["end_seconds"], F.lit(0.0)).alias("end_seconds"),
            _text(s["shot_size"]).alias("shot_size"), _text(s["camera_angle"]).alias("camera_angle"),
            _text(s["camera_motion"]).alias("camera_motion"), _amount(s["camera_motion_amount"]).alias("camera_motion_amount"),
            _text(s["composition"]).alias("composition"),
            clamp(F.coalesce(s["confidence"], F.lit(0.0)), 0, 1).alias("confidence"),
            position.alias("subject_screen_position"), size.alias("subject_screen_size"),
            _once(people, lambda q: F.when((F.size(q) == 0) & (role != ""), alone).otherwise(q)).alias("subjects"),
            F.when(ots["side"].isin("left", "right"), F.struct(
                ots["side"].alias("side"), clamp(F.coalesce(ots["screen_x"], F.lit(0.0)), 0, 1).alias("screen_x"),
                clamp(F.coalesce(ots["screen_width"], F.lit(0.0)), 0, 1).alias("screen_width"))).alias("over_the_shoulder"))

    error = (F.when(p.isNull() | p["broken"].isNotNull(), "json").when(version != 1, "schema_version")
             .when(~mode.isin("scene", "edit"), "match_mode")
             .when(F.coalesce(F.size(p["shots"]), F.lit(0)) <= 0, "shots").when(F.size(p["shots"]) > MAX_SHOTS, "too_many"))
    parsed = bind(docs, __p=_parse(F.col(text), REFERENCE_SCHEMA))
    return parsed.select(
        *docs.columns, error.alias("error"), _text(p["title"]).alias("title"), mode.alias("match_mode"),
        clamp(F.coalesce(p["aspect_ratio"], F.lit(1.7778)), 0.25, 4.0).alias("aspect_ratio"),
        F.when(error.isNull(), F.transform(p["shots"], shot)).alias("shots"))


def explode_shots(plans: DataFrame, ids: list[str]) -> DataFrame:
    """One row per shot with its ordinal."""
    # the outer form infers no filter on the parsed array, which would parse it again
    return plans.select(*ids, F.posexplode_outer("shots").alias("shot_idx", "shot")).where("shot_idx IS NOT NULL").select(
        *ids, F.col("shot_idx").cast("bigint").alias("shot_idx"), "shot.*")


def explode_subjects(shots: DataFrame, ids: list[str]) -> DataFrame:
    return shots.select(*ids, F.posexplode_outer("subjects").alias("subject_idx", "s")).where("subject_idx IS NOT NULL").select(
        *ids, F.col("subject_idx").cast("bigint").alias("subject_idx"), F.col("s.role").alias("role"),
        F.col("s.screen_position.x").alias("x"), F.col("s.screen_position.y").alias("y"),
        F.col("s.screen_size.width").alias("width"), F.col("s.screen_size.height").alias("height"),
        F.col("s.depth_order").alias("depth_order"))


def write_reference_json(plans: DataFrame, out: str = "json") -> DataFrame:
    """Accepted plans as documents; optional objects only when they are set."""
    return plans.where("error IS NULL").withColumn(out, F.to_json(F.struct(
        F.lit(1).alias("schema_version"), "title", "match_mode", "aspect_ratio", "shots")))


def read_cinematic_plans(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Parse camera plan documents; same contract as the reference plans."""
    p = F.col("__p")

    def shot(s: Column) -> Column:
        placed = F.filter(F.coalesce(s["actor_placements"], F.array()), lambda a: a["actor"].isNotNull()
                          & a["location"]["x"].isNotNull() & a["location"]["y"].isNotNull() & a["location"]["z"].isNotNull())
        ots = s["over_shoulder"]
        number = {"duration_seconds": 0.0, "focal_length": 50.0, "distance_cm": 300.0, "height_cm": 60.0, "side_cm": 0.0,
                  "camera_roll": 0.0, "subject_screen_x": 0.5, "subject_screen_y": 0.5, "focus_height": 0.5}
        words = ["name", "description", "subject", "look_at", "animation_id", "audio_id", "speaker", "dialogue",
                 "lip_sync_animation_id", "camera_motion"]
        return F.struct(
            *[_text(s[w]).alias(w) for w in words], _amount(s["camera_motion_amount"]).alias("camera_motion_amount"),
            *[F.coalesce(s[n], F.lit(d)).alias(n) for n, d in number.items()],
            s["camera_location"].alias("camera_location"), s["camera_rotation"].alias("camera_rotation"),
            placed.alias("actor_placements"),
            F.when(_text(ots["actor"]) != "", F.struct(
                ots["actor"].alias("actor"), F.when(ots["side"] == "left", "left").otherwise("right").alias("side"),
                clamp(F.coalesce(ots["edge_x"], F.lit(0.85)), 0.02, 0.98).alias("edge_x"))).alias("over_shoulder"))

    homeless = F.exists(p["shots"], lambda s: (_text(s["subject"]) == "") & (
        s["camera_location"]["x"].isNull() | s["camera_location"]["y"].isNull() | s["camera_location"]["z"].isNull()
        | s["camera_rotation"]["pitch"].isNull() | s["camera_rotation"]["yaw"].isNull() | s["camera_rotation"]["roll"].isNull()))
    error = (F.when(p.isNull() | p["broken"].isNotNull(), "json").when(p["shots"].isNull(), "shots")
             .when(homeless, "camera"))
    parsed = bind(docs, __p=_parse(F.col(text), CINEMATIC_SCHEMA))
    title = F.trim(_text(p["title"]))
    return parsed.select(
        *docs.columns, error.alias("error"), F.when(title == "", "GeneratedCinematic").otherwise(title).alias("title"),
        F.floor(F.coalesce(p["frame_rate"], F.lit(30.0)) + 0.5).cast("int").alias("frame_rate"),
        F.coalesce(p["aspect_ratio"], F.lit(1.7778)).alias("aspect_ratio"),
        F.when(error.isNull(), F.transform(p["shots"], shot)).alias("shots"))


def filled_cameras(plans: DataFrame) -> DataFrame:
    """Camera plans whose shots all have a camera place and rotation, zero where the document has none, as every placement has a rotation."""
    zero = lambda p, names: F.struct(*[F.coalesce(p[n], F.lit(0.0)).alias(n) for n in names])
    turned = lambda a: F.struct(a["actor"].alias("actor"), a["location"].alias("location"), zero(a["rotation"], ("pitch", "yaw", "roll")).alias("rotation"))
    return plans.withColumn("shots", F.transform("shots", lambda s: s.withField("camera_location", zero(s["camera_location"], "xyz")).withField(
        "camera_rotation", zero(s["camera_rotation"], ("pitch", "yaw", "roll"))).withField("actor_placements", F.transform(s["actor_placements"], turned))))


def write_cinematic_json(plans: DataFrame, out: str = "json") -> DataFrame:
    """Accepted camera plans as documents that parse back equal to :func:`filled_cameras`.

    The size of a move, its subject scale, placements and an over-shoulder person are left out where they are not set.
    """
    some = F.transform("shots", lambda s: s.withField("actor_placements", F.when(F.size(s["actor_placements"]) > 0, s["actor_placements"])))
    ready = filled_cameras(plans.where("error IS NULL"))
    return ready.withColumn(out, F.to_json(F.struct("title", "frame_rate", "aspect_ratio", some.alias("shots"))))


def camera_preview(plans: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, line_no, text): a heading of each camera plan (line 0) and the lines of each of its shots, with running times."""
    cm = lambda c: F.floor(c + 0.5).cast("double")
    share = lambda c: F.floor(c * 100 + 0.5) / 100
    named = lambda c, other: F.when(c == "", other).otherwise(c)
    starts = F.aggregate("shots", F.array(F.lit(0.0)), lambda t, s: F.array_append(t, F.element_at(t, -1) + s["duration_seconds"]))

    def lines(s: Column, i: Column) -> Column:
        start = F.get("__t", i)
        camera = F.format_string("    Camera: front %.0fcm / side %.0fcm / height %.0fcm | aim height %.2f | screen (%.2f, %.2f) | motion %s", cm(s["distance_cm"]), cm(s["side_cm"]),
                                 cm(s["height_cm"]), share(s["focus_height"]), share(s["subject_screen_x"]), share(s["subject_screen_y"]), named(s["camera_motion"], "static"))
        return F.concat_ws("\n", F.format_string("%02d  %6.2fs-%6.2fs  %s  %.1fmm", i + 1, start, start + s["duration_seconds"], s["name"], s["focal_length"]),
                           F.format_string("    Subject: %s / LookAt: %s", named(s["subject"], "<absolute>"), named(s["look_at"], "<subject>")),
                           F.format_string("    Animation: %s / Audio: %s", named(s["animation_id"], "-"), named(s["audio_id"], "-")),
                           F.when(s["subject"] != "", camera), F.when(s["description"] != "", F.concat(F.lit("    "), s["description"])))

    heading = F.format_string("%s | %d fps | %.3f:1 | %d shots", "title", "frame_rate", "aspect_ratio", F.size("shots"))
    timed = bind(plans.where("error IS NULL"), __t=starts)
    return timed.select(*ids, F.posexplode(F.concat(F.array(heading), F.transform("shots", lines))).alias("line_no", "text"))


def read_render_report(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Comparison reports with the first reason of refusal."""
    p = F.col("__p")
    fields = ["composition_score", "subject_position_score", "shot_size_score", "camera_angle_score"]

    def bad(s: Column, f: str) -> Column:
        return s[f].isNull() | ~s[f].between(0, 100)

    first_bad = F.filter(F.transform(p["shots"], lambda s, i: F.struct(i.alias("i"), F.coalesce(
        *[F.when(bad(s, f), F.lit(f)) for f in fields]).alias("f"))), lambda x: x["f"].isNotNull())
    where = F.get(first_bad, F.lit(0))
    error = (F.when(p.isNull() | p["broken"].isNotNull(), "json")
             .when(p["overall_score"].isNull() | ~p["overall_score"].between(0, 100), "overall_score")
             .when(F.coalesce(F.size(p["shots"]), F.lit(0)) <= 0, "shots")
             .when(where.isNotNull(), F.concat(F.lit("shot "), where["i"] + 1, F.lit(" "), where["f"])))
    parsed = bind(docs, __p=_parse(F.col(text), REPORT_SCHEMA))
    return parsed.select(*docs.columns, error.alias("error"), p["overall_score"].alias("overall_score"),
                         F.size(p["shots"]).alias("shot_count"))


def shot_errors(shots: DataFrame, keys: list[str], previous_end: str = "previous_end") -> DataFrame:
    """One row per broken rule of a reference shot."""
    x, y = F.col("subject_screen_position.x"), F.col("subject_screen_position.y")
    w, h = F.col("subject_screen_size.width"), F.col("subject_screen_size.height")
    rules = {
        "name": F.col("name") == "", "length": F.col("end_seconds") <= F.col("start_seconds"),
        "overlap": F.col("start_seconds") < F.coalesce(F.col(previous_end), F.lit(0.0)) - 1e-4,
        "too_late": F.col("end_seconds") > 7200.0, "position": ~(x.between(0, 1) & y.between(0, 1)),
        "size": (w <= 0) | (w > 1) | (h <= 0) | (h > 1), "shot_size": ~F.col("shot_size").isin(C.SIZE_ORDER),
        "camera_angle": ~F.col("camera_angle").isin(C.ANGLES), "camera_motion": ~F.col("camera_motion").isin(C.MOTIONS),
        "composition": ~F.col("composition").isin(C.COMPOSITIONS),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return shots.select(*keys, F.explode(found).alias("error"))


def with_previous_end(plans: DataFrame) -> DataFrame:
    """Add to each shot of the document the end of the shot before it (no shuffle: same document)."""
    ends = F.concat(F.array(F.lit(None).cast("double")), F.transform("shots", lambda s: s["end_seconds"]))
    return plans.withColumn("shots", F.zip_with(
        "shots", F.slice(ends, F.lit(1), F.size("shots")), lambda s, e: s.withField("previous_end", e)))
