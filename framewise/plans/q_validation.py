"""Documents, rule sets and filters over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import text as T
from framewise.operators import validation as VA
from framewise.plans import bindings as B
from framewise.plans.q_functions import LINE_KEYS, LK, r6
from framewise.plans.registry import query, table
from framewise.sources import plans as P

SIZES = ["wide", "full", "medium", "close_up", "banana"]
NAMED = ["main_character", "character_2", "", "extra"]


def doc_shots(spark, sf):
    """Shot fields of the stand-in plan documents."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    ls = B.order_shots(spark, sf)
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    start = F.col("shot_idx") * 4.0 - F.when(pk % 23 == 0, 2.0).otherwise(0.0)
    return ls.select(
        "plan", "shot_idx", "l_orderkey",
        F.when(pk % 41 != 0, F.concat(F.lit("Shot_"), F.col("shot_idx") + 1)).otherwise("").alias("name"),
        F.get(arr(NAMED), (pk % 4).cast("int")).alias("subject_role"), start.alias("start_seconds"),
        (start + F.col("l_quantity") / 12.5 - F.when(pk % 37 == 0, 4.5).otherwise(0.0)).alias("end_seconds"),
        F.get(arr(SIZES), (pk % 5).cast("int")).alias("shot_size"), F.get(arr(C.ANGLES), (sk % 5).cast("int")).alias("camera_angle"),
        F.get(arr([*C.MOTIONS, "spin"]), ((pk + sk) % 14).cast("int")).alias("camera_motion"),
        F.when(F.col("l_linestatus") == "O", F.struct(
            (F.col("l_discount") - 0.05).alias("screen_dx"), (F.col("l_tax") * 10 - 0.3).alias("background_scale"),
            F.col("l_linenumber").alias("steps"))).alias("camera_motion_amount"),
        F.get(arr(C.COMPOSITIONS), (pk % 4).cast("int")).alias("composition"), (F.col("l_discount") * 12).alias("confidence"),
        F.when(pk % 3 != 0, F.struct((F.col("l_quantity") / 48).alias("x"), F.lit(0.5).alias("y"))).alias("subject_screen_position"),
        F.struct((F.col("l_tax") * 10).alias("width"), F.lit(0.4).alias("height")).alias("subject_screen_size"),
        F.when(sk % 3 == 0, F.array(
            F.struct(F.lit("main_character").alias("role"), F.struct((F.col("l_quantity") / 45).alias("x")).alias("screen_position"),
                     F.lit(0).alias("depth_order")),
            F.struct(F.lit("character_2").alias("role"), F.struct(F.lit(0.25).alias("x")).alias("screen_position"),
                     F.lit(1).alias("depth_order")))).alias("subjects"),
        F.when(sk % 7 == 0, F.struct(F.get(arr(["left", "right", "up"]), (pk % 3).cast("int")).alias("side"),
                                     F.lit(1.4).alias("screen_x"))).alias("over_the_shoulder"))


def plan_docs(spark, sf):
    """One JSON document per plan (a plan has at most 100 shots)."""
    shots = doc_shots(spark, sf)
    fields = [c for c in shots.columns if c not in ("plan", "l_orderkey")]
    g = shots.withColumn("s", F.struct(*[c for c in fields if c != "shot_idx"])).groupBy("plan").agg(
        F.first("l_orderkey").alias("ok"), F.sort_array(F.collect_list(F.struct("shot_idx", "s"))).alias("m"))
    ordered = F.transform("m", lambda x: x["s"])
    doc = F.to_json(F.struct(
        F.when(F.col("ok") % 10 == 0, 2).when(F.col("ok") % 3 == 0, 1).alias("schema_version"),
        F.concat(F.lit("Plan_"), "ok").alias("title"), F.when(F.col("ok") % 7 == 0, "loose").when(F.col("ok") % 2 == 0, "edit").alias("match_mode"),
        ((F.col("ok") % 50) / 10).alias("aspect_ratio"), ordered.alias("shots")))
    return g.select("plan", F.when(F.col("ok") % 53 == 0, F.substring(doc, 1, 40)).otherwise(doc).alias("doc"))


SQL_DOC = B.LS + f""", ds AS (SELECT plan, shot_idx, l_orderkey AS ok, l_suppkey AS sk, l_partkey AS pk, l_linestatus, l_discount, l_tax, l_quantity, l_linenumber,
 CASE WHEN l_partkey % 41 <> 0 THEN 'Shot_' || (shot_idx + 1) ELSE '' END AS name, ({NAMED})[l_partkey % 4 + 1] AS role,
 shot_idx * 4.0::DOUBLE - CASE WHEN l_partkey % 23 = 0 THEN 2.0 ELSE 0.0 END AS st,
 (shot_idx * 4.0::DOUBLE - CASE WHEN l_partkey % 23 = 0 THEN 2.0 ELSE 0.0 END) + l_quantity / 12.5 - CASE WHEN l_partkey % 37 = 0 THEN 4.5 ELSE 0.0 END AS en,
 ({SIZES})[l_partkey % 5 + 1] AS size, ({C.ANGLES})[l_suppkey % 5 + 1] AS angle, ({[*C.MOTIONS, 'spin']})[(l_partkey + l_suppkey) % 14 + 1] AS motion,
 least(1.0, l_discount * 12) AS confidence, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity / 48 ELSE 0.5 END AS px, l_tax * 10 AS w FROM ls),
pe AS (SELECT plan, any_value(ok) AS ok, CASE WHEN any_value(ok) % 53 = 0 THEN 'json' WHEN any_value(ok) % 10 = 0 THEN 'schema_version' WHEN any_value(ok) % 7 = 0 THEN 'match_mode' END AS error FROM ds GROUP BY plan),
gs AS (SELECT ds.* FROM ds JOIN pe ON pe.plan = ds.plan AND pe.error IS NULL)"""


@query("s2_read_reference_plans", f"""WITH {SQL_DOC} SELECT plan, coalesce(error, 'ok') AS error, CASE WHEN error IS NULL THEN 'Plan_' || ok END AS title,
 CASE WHEN error IS NULL THEN greatest(0.25, least(4.0, (ok % 50) / 10)) END AS aspect_ratio FROM pe""")
def _(spark, sf):
    p = P.read_reference_plans(plan_docs(spark, sf))
    good = F.col("error").isNull()
    return p.select("plan", F.coalesce("error", F.lit("ok")).alias("error"), F.when(good, F.col("title")).alias("title"),
                    F.when(good, F.col("aspect_ratio")).alias("aspect_ratio"))


@query("s2_reference_shots", f"""WITH {SQL_DOC} SELECT plan, shot_idx, name, role AS subject_role, round(st, 6) AS start_seconds, round(en, 6) AS end_seconds, size AS shot_size,
 round(confidence, 6) AS confidence, round(px, 6) AS x, CASE WHEN l_linestatus = 'O' THEN round(CASE WHEN l_tax * 10 - 0.3 > 0 THEN l_tax * 10 - 0.3 ELSE 1.0 END, 6) END AS background_scale,
 CASE WHEN sk % 7 = 0 AND pk % 3 < 2 THEN (['left', 'right'])[pk % 3 + 1] END AS ots_side,
 CASE WHEN sk % 3 = 0 THEN CASE WHEN l_quantity / 45 <= 1 THEN 2 ELSE 1 END WHEN role <> '' THEN 1 ELSE 0 END AS n_subjects FROM gs""")
def _(spark, sf):
    s = P.explode_shots(P.read_reference_plans(plan_docs(spark, sf)), ["plan"])
    return s.select("plan", "shot_idx", "name", "subject_role", r6(F.col("start_seconds")).alias("start_seconds"),
                    r6(F.col("end_seconds")).alias("end_seconds"), "shot_size", r6(F.col("confidence")).alias("confidence"),
                    r6(F.col("subject_screen_position.x")).alias("x"),
                    r6(F.col("camera_motion_amount.background_scale")).alias("background_scale"),
                    F.col("over_the_shoulder.side").alias("ots_side"), F.size("subjects").alias("n_subjects"))


@query("s2_reference_subjects", f"""WITH {SQL_DOC} SELECT plan, shot_idx, 0::BIGINT AS subject_idx, 'main_character' AS role, round(l_quantity / 45, 6) AS x, 0.25 AS width FROM gs WHERE sk % 3 = 0 AND l_quantity / 45 <= 1
UNION ALL SELECT plan, shot_idx, CASE WHEN l_quantity / 45 <= 1 THEN 1 ELSE 0 END, 'character_2', 0.25, 0.25 FROM gs WHERE sk % 3 = 0
UNION ALL SELECT plan, shot_idx, 0, role, round(px, 6), round(w, 6) FROM gs WHERE sk % 3 <> 0 AND role <> ''""")
def _(spark, sf):
    s = P.explode_shots(P.read_reference_plans(plan_docs(spark, sf)), ["plan"])
    return P.explode_subjects(s, ["plan", "shot_idx"]).select(
        "plan", "shot_idx", "subject_idx", "role", r6(F.col("x")).alias("x"), r6(F.col("width")).alias("width"))


@query("f1_validate_reference_shots", f"""WITH {SQL_DOC}, v AS (SELECT *, lag(en) OVER (PARTITION BY plan ORDER BY shot_idx) AS pend FROM gs)
SELECT plan, shot_idx, unnest(list_filter([CASE WHEN name = '' THEN 'name' END, CASE WHEN en <= st THEN 'length' END,
 CASE WHEN st < coalesce(pend, 0.0) - 1e-4 THEN 'overlap' END, CASE WHEN en > 7200 THEN 'too_late' END, CASE WHEN px < 0 OR px > 1 THEN 'position' END,
 CASE WHEN w <= 0 OR w > 1 THEN 'size' END, CASE WHEN size = 'banana' THEN 'shot_size' END, CASE WHEN motion = 'spin' THEN 'camera_motion' END], lambda x: x IS NOT NULL)) AS error FROM v""")
def _(spark, sf):
    p = P.with_previous_end(P.read_reference_plans(plan_docs(spark, sf)))
    return P.shot_errors(P.explode_shots(p, ["plan"]), ["plan", "shot_idx"])


@query("k1_write_plan_json", f"""WITH {SQL_DOC} SELECT plan, count(*) AS n_shots, true AS round_trip FROM gs GROUP BY plan""")
def _(spark, sf):
    written = P.write_reference_json(P.read_reference_plans(plan_docs(spark, sf)), "json")
    again = P.read_reference_plans(written.select("plan", F.col("shots").alias("before"), F.col("json").alias("doc")))
    return again.select("plan", F.size("shots").cast("bigint").alias("n_shots"),
                        (F.col("before") == F.col("shots")).alias("round_trip"))


def cinematic_shots(spark, sf):
    ls = B.order_shots(spark, sf)
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda c, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    return ls.select(
        "plan", "shot_idx", F.col("l_orderkey").alias("ok"),
        F.when(pk % 41 == 0, " ").otherwise(F.concat(F.lit("S"), "shot_idx")).alias("name"),
        pick(pk, "hero", "", "rival", "hero").alias("subject"), pick(sk, "", "hero", "door").alias("look_at"),
        pick(pk, "", "walk", "", "", "run").alias("animation_id"), pick(sk, "", "line1").alias("audio_id"),
        pick(pk, "", "hello", "").alias("dialogue"), pick(pk, "", "", "lips").alias("lip_sync_animation_id"),
        pick(pk + sk, *C.MOTIONS, "spin", "").alias("camera_motion"),
        (F.col("l_quantity") * 2.6 - 3).alias("duration_seconds"), (F.col("l_quantity") * 4.4).alias("focal_length"),
        (F.col("l_extendedprice") / 10).alias("distance_cm"), ((F.col("l_discount") - 0.05) * 110000).alias("height_cm"),
        ((F.col("l_tax") - 0.04) * 130000).alias("side_cm"), (F.col("l_quantity") / 48).alias("subject_screen_x"),
        F.lit(0.5).alias("subject_screen_y"), (F.col("l_tax") * 13).alias("focus_height"),
        F.when(pk % 6 == 1, F.struct((F.col("l_extendedprice") * 10).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
        .when(pk % 6 == 3, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).alias("camera_location"),
        F.when(pk % 2 == 1, F.struct(F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"), F.lit(0.0).alias("roll"))).alias("camera_rotation"),
        F.when(sk % 4 == 0, F.array(*[F.struct(
            F.when(pk % m != 0, pick(pk + i * sk, "hero", "rival", "")).alias("actor"),
            F.struct(F.when(sk % (m + 3) != 0, F.lit(1.0)).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")).alias("location"))
            for i, m in ((1, 7), (2, 9))])).alias("actor_placements"),
        F.when(sk % 5 == 0, F.struct(pick(pk, "rival", "").alias("actor"), pick(pk, "left", "right", "x").alias("side"),
                                     (F.col("l_quantity") / 30).alias("edge_x"))).alias("over_shoulder"))


def cinematic_docs(spark, sf):
    shots = cinematic_shots(spark, sf)
    fields = [c for c in shots.columns if c not in ("plan", "ok", "shot_idx")]
    g = shots.withColumn("s", F.struct(*fields)).groupBy("plan").agg(
        F.first("ok").alias("ok"), F.sort_array(F.collect_list(F.struct("shot_idx", "s"))).alias("m"))
    ordered = F.transform("m", lambda x: x["s"])
    doc = F.to_json(F.struct(F.when(F.col("ok") % 5 == 0, "  ").otherwise(F.concat(F.lit(" Cine_"), "ok")).alias("title"),
                             (F.col("ok") % 130).alias("frame_rate"), ((F.col("ok") % 50) / 10).alias("aspect_ratio"),
                             F.when(F.col("ok") % 31 != 0, ordered).alias("shots")))
    return g.select("plan", F.when(F.col("ok") % 53 == 0, F.substring(doc, 1, 30)).otherwise(doc).alias("doc"))


def _sql_pick(c, *xs):
    return f"({list(xs)})[({c}) % {len(xs)} + 1]"


SQL_CINE = B.LS + f""", cs AS (SELECT plan, shot_idx, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_quantity, CASE WHEN l_partkey % 41 = 0 THEN ' ' ELSE 'S' || shot_idx END AS name,
 {_sql_pick('l_partkey', 'hero', '', 'rival', 'hero')} AS subject, {_sql_pick('l_suppkey', '', 'hero', 'door')} AS look_at, {_sql_pick('l_partkey', '', 'walk', '', '', 'run')} AS animation_id,
 {_sql_pick('l_suppkey', '', 'line1')} AS audio_id, {_sql_pick('l_partkey', '', 'hello', '')} AS dialogue, {_sql_pick('l_partkey', '', '', 'lips')} AS lip_sync,
 {_sql_pick('l_partkey + l_suppkey', *C.MOTIONS, 'spin', '')} AS motion, l_quantity * 2.6 - 3 AS dur, l_quantity * 4.4 AS focal, l_extendedprice / 10 AS dist,
 (l_discount - 0.05) * 110000 AS height, (l_tax - 0.04) * 130000 AS side, l_quantity / 48 AS sx, l_tax * 13 AS foc,
 CASE WHEN l_partkey % 6 = 1 THEN l_extendedprice * 10 WHEN l_partkey % 6 = 3 THEN 0.0 END AS cx, l_partkey % 2 = 1 AS has_rot FROM ls),
pe AS (SELECT plan, any_value(ok) AS ok, CASE WHEN any_value(ok) % 53 = 0 THEN 'json' WHEN any_value(ok) % 31 = 0 THEN 'shots'
 WHEN bool_or(subject = '' AND (cx IS NULL OR NOT has_rot)) THEN 'camera' END AS error FROM cs GROUP BY plan),
pl AS (SELECT plan, error, CASE WHEN ok % 5 = 0 THEN 'GeneratedCinematic' ELSE 'Cine_' || ok END AS title, (ok % 130)::INT AS fr, (ok % 50) / 10 AS aspect FROM pe WHERE error IS NULL),
sh AS (SELECT cs.* FROM cs JOIN pl ON pl.plan = cs.plan),
pm AS (SELECT plan, shot_idx, actor FROM (SELECT plan, shot_idx, pk, sk, CASE WHEN pk % 7 <> 0 THEN {_sql_pick('pk + sk', 'hero', 'rival', '')} END AS actor FROM sh WHERE sk % 4 = 0 AND sk % 10 <> 0
 UNION ALL SELECT plan, shot_idx, pk, sk, CASE WHEN pk % 9 <> 0 THEN {_sql_pick('pk + 2 * sk', 'hero', 'rival', '')} END FROM sh WHERE sk % 4 = 0 AND sk % 12 <> 0) WHERE actor IS NOT NULL)"""


@query("s3_read_cinematic_plans", f"""WITH {SQL_CINE}, n AS (SELECT plan, shot_idx, count(*) AS n FROM pm GROUP BY ALL)
SELECT sh.plan, sh.shot_idx, pl.title, pl.fr AS frame_rate, sh.subject, round(dur, 6) AS duration_seconds, coalesce(n.n, 0)::INT AS n_placements,
 CASE WHEN sk % 5 = 0 AND pk % 2 = 0 THEN CASE WHEN pk % 3 = 0 THEN 'left' ELSE 'right' END END AS ots_side,
 CASE WHEN sk % 5 = 0 AND pk % 2 = 0 THEN round(greatest(0.02, least(0.98, l_quantity / 30)), 6) END AS ots_edge
FROM sh JOIN pl USING (plan) LEFT JOIN n ON n.plan = sh.plan AND n.shot_idx = sh.shot_idx""")
def _(spark, sf):
    p = P.read_cinematic_plans(cinematic_docs(spark, sf))
    s = P.explode_shots(p.where("error IS NULL"), ["plan", "title", "frame_rate"])
    return s.select("plan", "shot_idx", "title", "frame_rate", "subject", r6(F.col("duration_seconds")).alias("duration_seconds"),
                    F.size("actor_placements").alias("n_placements"), F.col("over_shoulder.side").alias("ots_side"),
                    r6(F.col("over_shoulder.edge_x")).alias("ots_edge"))


@query("k1_write_camera_plans", f"""WITH {SQL_CINE}, p AS (SELECT plan, count(DISTINCT shot_idx) AS n FROM pm GROUP BY plan)
SELECT plan, any_value(title) AS title, count(*) AS n_shots, coalesce(any_value(p.n), 0) AS n_placed, count(*) FILTER (WHERE sk % 5 = 0 AND pk % 2 = 0) AS n_over_shoulder, true AS round_trip FROM sh JOIN pl USING (plan) LEFT JOIN p USING (plan) GROUP BY plan""")
def _(spark, sf):
    """Camera plans written and read again: equal shots, and optional objects only where they are set."""
    plans = P.read_cinematic_plans(cinematic_docs(spark, sf))
    written = P.write_cinematic_json(plans)
    again = P.filled_cameras(P.read_cinematic_plans(written.select("plan", F.col("shots").alias("before"), F.col("json").alias("doc"))))
    times = lambda name: F.regexp_count("doc", F.lit(f'"{name}"')).cast("bigint")
    return again.select("plan", "title", F.size("shots").cast("bigint").alias("n_shots"), times("actor_placements").alias("n_placed"), times("over_shoulder").alias("n_over_shoulder"),
                        (F.col("before") == F.col("shots")).alias("round_trip"))


@query("k5_camera_plan_preview", f"""WITH {SQL_CINE}, t AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY plan ORDER BY shot_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS st FROM sh)
SELECT plan, 0 AS line_no, printf('%s | %d fps | %.3f:1 | %d shots', title, fr, aspect::DOUBLE, (SELECT count(*) FROM sh WHERE sh.plan = pl.plan)) AS text FROM pl
UNION ALL SELECT plan, shot_idx::INT + 1, printf('%02d  %6.2fs-%6.2fs  %s  %.1fmm', shot_idx + 1, st, st + dur, name, focal) || chr(10) || printf('    Subject: %s / LookAt: %s', CASE WHEN subject = '' THEN '<absolute>' ELSE subject END, CASE WHEN look_at = '' THEN '<subject>' ELSE look_at END)
 || chr(10) || printf('    Animation: %s / Audio: %s', CASE WHEN animation_id = '' THEN '-' ELSE animation_id END, CASE WHEN audio_id = '' THEN '-' ELSE audio_id END)
 || CASE WHEN subject = '' THEN '' ELSE chr(10) || printf('    Camera: front %.0fcm / side %.0fcm / height %.0fcm | aim height %.2f | screen (%.2f, %.2f) | motion %s', floor(dist + 0.5), floor(side + 0.5), floor(height + 0.5), floor(foc * 100 + 0.5) / 100, floor(sx * 100 + 0.5) / 100, 0.5, CASE WHEN motion = '' THEN 'static' ELSE motion END) END FROM t""")
def _(spark, sf):
    return P.camera_preview(P.read_cinematic_plans(cinematic_docs(spark, sf)), ["plan"])


@query("f2_validate_cinematic_plan", f"""WITH {SQL_CINE}, tt AS (SELECT plan, count(*) AS n, sum(dur) AS total FROM sh GROUP BY plan)
SELECT plan, NULL::BIGINT AS shot_idx, 'error' AS level, unnest(list_filter([CASE WHEN fr < 1 OR fr > 120 THEN 'frame_rate' END, CASE WHEN aspect < 0.25 OR aspect > 4 THEN 'aspect_ratio' END,
 CASE WHEN n > 100 THEN 'too_many_shots' END, CASE WHEN total > 1800 THEN 'total_duration' END], lambda x: x IS NOT NULL)) AS rule FROM pl JOIN tt USING (plan)
UNION ALL SELECT plan, shot_idx, CASE WHEN r = 'dialogue_audio' THEN 'warning' ELSE 'error' END, r FROM (SELECT plan, shot_idx, unnest(list_filter([CASE WHEN trim(name) = '' THEN 'name' END,
 CASE WHEN dur < 0.1 OR dur > 120 THEN 'duration' END, CASE WHEN focal < 8 OR focal > 200 THEN 'focal_length' END, CASE WHEN animation_id <> '' AND subject = '' THEN 'animation_subject' END,
 CASE WHEN dist < 30 OR dist > 10000 THEN 'distance' END, CASE WHEN abs(height) > 5000 OR abs(side) > 5000 THEN 'offset' END, CASE WHEN sx < 0 OR sx > 1 THEN 'screen' END,
 CASE WHEN foc < 0 OR foc > 1 THEN 'focus_height' END, CASE WHEN cx > 1000000 THEN 'location' END, CASE WHEN lip_sync <> '' AND subject = '' THEN 'lip_sync_subject' END,
 CASE WHEN dialogue <> '' AND audio_id = '' THEN 'dialogue_audio' END], lambda x: x IS NOT NULL)) AS r FROM sh)""")
def _(spark, sf):
    return VA.validate_cinematic_plan(P.read_cinematic_plans(cinematic_docs(spark, sf)).where("error IS NULL"), ["plan"])


@query("f3_validate_blocking", f"""WITH {SQL_CINE}, pc AS (SELECT plan, shot_idx, actor, count(*) AS n FROM pm GROUP BY ALL), pg AS (SELECT plan, shot_idx, bool_or(actor = '') AS emp, bool_or(actor <> '' AND n > 1) AS dup FROM pc GROUP BY ALL)
SELECT plan, NULL::BIGINT AS shot_idx, 'error' AS level, unnest(list_filter([CASE WHEN fr < 1 OR fr > 120 THEN 'frame_rate' END, CASE WHEN aspect < 0.25 OR aspect > 4 THEN 'aspect_ratio' END], lambda x: x IS NOT NULL)) AS rule FROM pl
UNION ALL SELECT plan, shot_idx, CASE WHEN r IN ('zoom_limit', 'look_at') THEN 'warning' ELSE 'error' END, r FROM (SELECT plan, shot_idx, unnest(list_filter([
 CASE WHEN dur < 0.1 OR dur > 120 THEN 'duration' END, CASE WHEN focal < 8 OR focal > 200 THEN 'focal_length' END, CASE WHEN dist < 20 OR dist > 10000 THEN 'distance' END,
 CASE WHEN subject = '' AND coalesce(cx, 0) <= 1e-4 THEN 'origin' END, CASE WHEN motion = 'spin' THEN 'motion' END, CASE WHEN motion IN ('zoom_in', 'zoom_out') AND focal >= 190 THEN 'zoom_limit' END,
 CASE WHEN subject <> '' AND look_at = '' THEN 'look_at' END], lambda x: x IS NOT NULL)) AS r FROM sh)
UNION ALL SELECT plan, shot_idx, 'error', unnest(list_filter([CASE WHEN emp THEN 'placement_label' END, CASE WHEN dup THEN 'placement_twice' END], lambda x: x IS NOT NULL)) FROM pg""")
def _(spark, sf):
    return VA.validate_blocking(P.read_cinematic_plans(cinematic_docs(spark, sf)).where("error IS NULL"), ["plan"])


@query("s8_read_render_report", f"""WITH {B.ES}, r AS (SELECT *, CASE WHEN confidence * 130 > 100 THEN 'composition_score' WHEN people = 3 AND shot_idx % 5 = 0 THEN 'shot_size_score' END AS bad FROM es),
g AS (SELECT reel, arg_min(bad, shot_idx) FILTER (WHERE bad IS NOT NULL) AS bad, min(shot_idx) FILTER (WHERE bad IS NOT NULL) AS at_, count(*)::INT AS n, reel % 9 AS m, reel % 130 AS overall FROM r GROUP BY reel)
SELECT reel, CASE WHEN m = 0 THEN 'json' WHEN overall > 100 THEN 'overall_score' WHEN bad IS NOT NULL THEN 'shot ' || (at_ + 1) || ' ' || bad END AS error FROM g""")
def _(spark, sf):
    es = B.event_shots(spark, sf)
    s = F.struct((F.col("confidence") * 130).alias("composition_score"), F.lit(50).alias("subject_position_score"),
                 F.when(~((F.col("people") == 3) & (F.col("shot_idx") % 5 == 0)), 70.5).alias("shot_size_score"), F.lit(0).alias("camera_angle_score"))
    g = es.groupBy("reel").agg(F.array_sort(F.collect_list(F.struct("shot_idx", s.alias("s")))).alias("m"))
    doc = F.to_json(F.struct((F.col("reel") % 130).alias("overall_score"),
                             F.transform("m", lambda x: x["s"]).alias("shots")))
    docs = g.select("reel", F.when(F.col("reel") % 9 == 0, F.substring(doc, 1, 25)).otherwise(doc).alias("doc"))
    return P.read_render_report(docs).select("reel", "error")


@query("s10_extract_json_answer", f"""WITH {B.EV} SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'no answer' ELSE '{{"k": ' || k || '}}' END AS answer,
 CASE WHEN event_id % 4 = 3 THEN NULL ELSE k END AS k FROM ev""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    m = F.col("event_id") % 4
    said = (F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("<think>maybe {x}</think>\n```json\n"), "props", F.lit("\n```")))
            .when(m == 2, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise(F.lit("<think>{}</THINK>  no answer ")))
    answer = T.extract_json_answer(said)
    return ev.select("event_id", answer.alias("answer"),
                     F.try_variant_get(F.try_parse_json(answer), "$.k", "int").alias("k"))


@query("f4_validate_media_file", r"""WITH f AS (SELECT page_id, url || (['.mp4', '.MOV', '.webm', ''])[page_id % 4 + 1] AS path, CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) * 2000000 END AS size FROM pages)
SELECT page_id, CASE WHEN lower(regexp_extract(path, '\.([^./?#]+)$', 1)) NOT IN ('mp4', 'mov', 'm4v', 'avi') THEN 'format' WHEN size <= 0 OR size > 2147483648 THEN 'size' END AS error FROM f""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    ext = F.get(F.array(*[F.lit(e) for e in [".mp4", ".MOV", ".webm", ""]]), (F.col("page_id") % 4).cast("int"))
    size = F.when(F.col("page_id") % 7 == 0, F.lit(0).cast("bigint")).otherwise(F.length("html").cast("bigint") * 2000000)
    return p.select("page_id", VA.media_file_error(F.concat("url", ext), size).alias("error"))


URL_OF = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '.example.', 'example.') WHEN 2 THEN 'ftp' || url WHEN 3 THEN 'http://localhost:11434/v1' ELSE url || ' x' END"


@query("f5_url_class", rf"""WITH u AS (SELECT page_id, {URL_OF} AS url FROM pages), h AS (SELECT *, CASE WHEN contains(url, ' ') THEN '' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) END AS host FROM u)
SELECT page_id, regexp_matches(url, '^https?://') AND NOT contains(url, ' ') AS well_formed, host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org') AS download_allowed,
 starts_with(lower(url), 'http://localhost') OR starts_with(url, 'http://127.0.0.1') AS is_local, starts_with(lower(url), 'https://') OR starts_with(lower(url), 'http://localhost') OR starts_with(url, 'http://127.0.0.1') AS endpoint_allowed FROM h""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(URL_OF).alias("url"))
    return VA.url_rows(p, "url", ["example.com", "example.org"]).drop("url")


@query("f7_min_area_boxes", f"SELECT {LK} FROM lineitem WHERE l_quantity * 2 * (l_discount * 100 + 1) >= 0.001 * 1280 * 720")
def _(spark, sf):
    return table(spark, sf, "lineitem").where(
        F.col("l_quantity") * 2 * (F.col("l_discount") * 100 + 1) >= 0.001 * 1280 * 720).select(*LINE_KEYS)


@query("f8_edge_touch_candidates", f"""WITH c AS (SELECT *, floor(l_discount * 100) - 1 AS x, l_quantity * 26 AS w, l_tax * 9000 AS h FROM lineitem),
s AS (SELECT *, CASE WHEN x + w >= 1277 THEN 'right' WHEN x <= 2 THEN 'left' END AS side FROM c WHERE w * h * 0.8 >= 0.03 * 1280 * 720 AND h >= 0.3 * 720) SELECT {LK}, side FROM s WHERE side IS NOT NULL""")
def _(spark, sf):
    w, h = F.col("l_quantity") * 26, F.col("l_tax") * 9000
    side = VA.edge_side(F.floor(F.col("l_discount") * 100) - 1, w, h, w * h * 0.8, 1280, 720)
    return table(spark, sf, "lineitem").select(*LINE_KEYS, side.alias("side")).where("side IS NOT NULL")


REQUESTS = {0: '{"size":"close_up","motion":"dolly_in"}', 1: '{"size":" Close_Up "}', 2: '{"size":"banana","people":7}', 3: '{"motion":"teleport","people":true}',
            4: '{"ots":true}', 5: '{"foo":"bar","angle":"low"}', 6: '["size"]', 7: '{"people":K}', 8: '{"ots":"true","people":2.5,"size":3}', 9: 'not json'}
CLEAN = {0: ("close_up", None, "dolly_in", None), 1: ("close_up", None, None, None), 4: ("medium", None, None, 1), 5: (None, "low", None, None), 8: (None, None, None, 2)}


@query("f9_clean_request_row", f"""WITH {B.EV} SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'close_up' WHEN 1 THEN 'close_up' WHEN 4 THEN 'medium' END AS size, CASE event_id % 10 WHEN 5 THEN 'low' END AS angle,
 CASE event_id % 10 WHEN 0 THEN 'dolly_in' END AS motion, CASE event_id % 10 WHEN 4 THEN 1 WHEN 8 THEN 2 WHEN 7 THEN CASE WHEN k BETWEEN 1 AND 3 THEN k END END AS people, event_id % 10 = 4 AS ots FROM ev""")
def _(spark, sf):
    ev = B.event_series(spark, sf)
    raw = F.replace(F.get(F.array(*[F.lit(REQUESTS[i]) for i in range(10)]), (F.col("event_id") % 10).cast("int")),
                    F.lit("K"), F.col("k").cast("string"))
    return ev.select("event_id", *[c.alias(n) for n, c in VA.clean_request(raw).items()])


@query("f10_prune_flat_curves", f"""WITH {B.EV}, c AS (SELECT reel, event_type AS curve, i, CASE WHEN reel % 3 = 0 AND event_type = 'view' THEN 0.0 ELSE value END AS v FROM ev)
SELECT reel, curve, i, v AS value FROM c WINDOW w AS (PARTITION BY reel, curve) QUALIFY NOT (max(v) OVER w - min(v) OVER w < 1e-6 AND abs(max(v) OVER w) < 1e-6)""")
def _(spark, sf):
    ev = B.event_series(spark, sf)
    zero = (F.col("reel") % 3 == 0) & (F.col("event_type") == "view")
    c = ev.select("reel", F.col("event_type").alias("curve"), "i", F.when(zero, 0.0).otherwise(F.col("value")).alias("value"))
    return VA.prune_flat_curves(c, ["reel", "curve"])


@query("f12_low_confidence_flags", """SELECT d.doc_id, 'shot_' || d.doc_id AS name, CASE WHEN d.lang = 'de' THEN 'no_person' ELSE 'low_confidence' END AS flag,
 CASE WHEN d.lang <> 'de' THEN floor(c * 100 + 0.5)::BIGINT END AS percent FROM (SELECT *, (n_chars % 97) / 96 AS c FROM documents) d LEFT JOIN labels USING (doc_id)
WHERE d.lang = 'de' OR c < CASE WHEN coalesce(quality, 0) = 1 THEN -1 ELSE 0.45 END""")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    c = (F.col("n_chars") % 97) / 96
    shots = d.select("doc_id", F.concat(F.lit("shot_"), "doc_id").alias("name"),
                     F.when(F.col("lang") == "de", "").otherwise("main_character").alias("subject_role"),
                     F.when(F.coalesce("quality", F.lit(0)) == 1, F.greatest(c, F.lit(0.45))).otherwise(c).alias("confidence"))
    return VA.low_confidence(shots, ["doc_id"], 0.45)


@query("f13_cropped_flag", f"""WITH b AS (SELECT *, l_discount * 100 AS l, l_tax * 200 AS t, 1180 + l_quantity * 2 AS r, 650.0 + l_linenumber * 10 AS bo FROM lineitem)
SELECT {LK}, l <= 4 OR t <= 4 OR r >= 1276 OR bo >= 716 OR l_extendedprice / 120 > greatest(1.0, bo - t) * 1.05 AS cropped FROM b""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEYS, VA.is_cropped(
        F.col("l_discount") * 100, F.col("l_tax") * 200, 1180 + F.col("l_quantity") * 2, 650.0 + F.col("l_linenumber") * 10,
        F.col("l_extendedprice") / 120, 1280, 720).alias("cropped"))


@query("f14_posture_guard", """WITH m AS (SELECT p_partkey, p_size / 50.0 + 0.4 AS readiness, p_partkey % 11 <> 0 AS ok, p_type <> 'SMALL' AS up FROM part),
p AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, (l_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a AS source_mesh, b AS target_mesh, CASE WHEN NOT s.ok OR s.readiness < 0.7 THEN 'source' WHEN NOT t.ok OR t.readiness < 0.7 THEN 'target' WHEN s.up <> t.up THEN 'posture' END AS reason
FROM p JOIN m s ON s.p_partkey = a JOIN m t ON t.p_partkey = b""")
def _(spark, sf):
    part = table(spark, sf, "part")
    meshes = part.select(F.col("p_partkey").alias("mesh"), (F.col("p_size") / 50.0 + 0.4).alias("readiness"),
                         (F.col("p_partkey") % 11 != 0).alias("overrides_valid"), (F.col("p_type") != "SMALL").alias("upright"))
    n = part.agg(F.count(F.lit(1))).scalar()
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_mesh"),
                                                ((F.col("l_partkey") * 7 + 3) % n).alias("target_mesh"))
    return VA.posture_guard(pairs, meshes)


@query("f15_referential_integrity", f"""WITH sh AS (SELECT {LK}, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS an, l_suppkey AS su, CASE WHEN l_linenumber > 5 THEN l_partkey * 2 END AS ls, CASE WHEN l_quantity > 45 THEN l_suppkey * 2 END AS au FROM lineitem),
a AS (SELECT p_partkey, p_size % 2 AS sk FROM part WHERE p_partkey % 13 <> 0), s AS (SELECT s_suppkey, s_nationkey % 2 AS sk FROM supplier WHERE s_suppkey % 17 <> 0)
SELECT {LK}, CASE WHEN an IS NOT NULL AND s.s_suppkey IS NULL THEN 'subject' WHEN an IS NOT NULL AND a.p_partkey IS NULL THEN 'animation' WHEN an IS NOT NULL AND a.sk <> s.sk THEN 'skeleton'
 WHEN ls IS NOT NULL AND l.p_partkey IS NULL THEN 'lip_sync' WHEN au IS NOT NULL AND d.s_suppkey IS NULL THEN 'audio' END AS reason
FROM sh LEFT JOIN a ON a.p_partkey = an LEFT JOIN s ON s.s_suppkey = su LEFT JOIN a l ON l.p_partkey = ls LEFT JOIN supplier d ON d.s_suppkey = au""")
def _(spark, sf):
    li, part, sup = (table(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    shots = li.select(*LINE_KEYS, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")).alias("animation_id"),
                      F.col("l_suppkey").alias("subject"), F.when(F.col("l_linenumber") > 5, F.col("l_partkey") * 2).alias("lip_sync_id"),
                      F.when(F.col("l_quantity") > 45, F.col("l_suppkey") * 2).alias("audio_id"))
    out = VA.referential_integrity(
        shots, part.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("animation_id"), (F.col("p_size") % 2).alias("skeleton")),
        sup.where("s_suppkey % 17 <> 0").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") % 2).alias("skeleton")),
        sup.select(F.col("s_suppkey").alias("audio_id")))
    return out.select(*LINE_KEYS, "reason")


@query("f16_expected_count_check", """WITH e AS (SELECT * FROM (VALUES ('A', 'F', 100), ('R', 'O', 1), ('N', 'O', 5), ('X', 'F', 3)) t(l_returnflag, l_linestatus, wanted)),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT e.*, coalesce(n, 0) AS produced, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n <> wanted THEN 'partial' ELSE 'ok' END AS status
FROM e LEFT JOIN c USING (l_returnflag, l_linestatus)""")
def _(spark, sf):
    expected = spark.createDataFrame([("A", "F", 100), ("R", "O", 1), ("N", "O", 5), ("X", "F", 3)],
                                     "l_returnflag string, l_linestatus string, wanted int")
    return VA.expected_counts(table(spark, sf, "lineitem"), expected, ["l_returnflag", "l_linestatus"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("f17_required_chain_check", f"""WITH h AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS have FROM orders GROUP BY 1), m AS (SELECT o_custkey, list_filter({PRIORITIES}, lambda r: NOT list_contains(have, r)) AS miss FROM h)
SELECT o_custkey, len(miss) = 0 AS valid, miss[1] AS first_missing FROM m""")
def _(spark, sf):
    return VA.required_parts(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", PRIORITIES)
