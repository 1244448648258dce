"""Scalar functions over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import keypoints as K
from framewise.functions import shot as S
from framewise.functions import text as T
from framewise.functions import vectors as V
from framewise.plans import bindings as B
from framewise.plans.registry import query, table

r6 = lambda c: F.round(c, 6)


def sql_case(expr: str, values: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


SQL_SIZE = ("CASE WHEN {h} <= 0.45 THEN 'wide' WHEN {h} <= 1.3 THEN 'full' WHEN {h} <= 2.8 THEN 'medium' "
            "WHEN {h} <= 5.5 THEN 'close_up' ELSE 'extreme_close_up' END")
HEIGHT = "(l_extendedprice / 15000.0)"
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
LK = ", ".join(LINE_KEYS)


def lines(spark, sf):
    """lineitem with a stand-in shot description per row."""
    sizes = F.array(*[F.lit(s) for s in ["wide", "full", "medium", "close_up", "extreme_close_up"]])
    angles = F.array(*[F.lit(a) for a in C.ANGLES])
    motions = F.array(*[F.lit(m) for m in C.MOTIONS])
    li = table(spark, sf, "lineitem")
    return li.withColumns({
        "size": F.get(sizes, (F.col("l_partkey") % 5).cast("int")),
        "angle": F.get(angles, (F.col("l_suppkey") % 5).cast("int")),
        "motion": F.get(motions, ((F.col("l_partkey") + F.col("l_suppkey")) % 13).cast("int")),
        "distance": 50 + F.col("l_extendedprice") / 50, "side": (F.col("l_quantity") - 25) * 8,
        "height": (F.col("l_discount") - 0.05) * 4000, "lens": 20 + F.col("l_quantity"),
        "aspect": 0.2 + F.col("l_tax") * 30,
    })


SQL_LINES = f"""li AS (SELECT *, (['wide','full','medium','close_up','extreme_close_up'])[l_partkey % 5 + 1] AS size,
 ({C.ANGLES})[l_suppkey % 5 + 1] AS angle, ({C.MOTIONS})[(l_partkey + l_suppkey) % 13 + 1] AS motion,
 50 + l_extendedprice / 50 AS distance, (l_quantity - 25) * 8 AS side, (l_discount - 0.05) * 4000 AS height,
 20 + l_quantity AS lens, 0.2 + l_tax * 30 AS aspect FROM lineitem)"""


@query("e1_classify_shot_size", f"SELECT {LK}, {SQL_SIZE.format(h=HEIGHT)} AS shot_size FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LINE_KEYS, S.classify_shot_size(F.col("l_extendedprice") / 15000.0).alias("shot_size"))


@query("e2_shot_size_tables", f"""WITH s AS (SELECT {LK}, {SQL_SIZE.format(h=HEIGHT)} AS size FROM lineitem)
SELECT {LK}, {sql_case('size', C.FOCUS_RATIO)}::DOUBLE AS focus, {sql_case('size', C.VISIBLE_RATIO)}::DOUBLE AS visible,
 {sql_case('size', C.LENS_MM)}::DOUBLE AS lens, {sql_case('size', C.DEFAULT_FRACTION)}::DOUBLE AS fraction FROM s""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    size = S.classify_shot_size(F.col("l_extendedprice") / 15000.0)
    return li.select(*LINE_KEYS, S.focus_ratio(size).alias("focus"), S.visible_ratio(size).alias("visible"),
                     S.lens_mm(size).alias("lens"), S.default_fraction(size).alias("fraction"))


@query("e3_classify_composition", f"""WITH {B.LS}, g AS (SELECT plan, max_by(l_quantity / 50.0, -shot_idx) AS main_x,
 list_sort(list(l_quantity / 50.0)) AS xs FROM ls GROUP BY plan)
SELECT plan, CASE WHEN len(xs) >= 2 AND abs((xs[1] + xs[2]) / 2 - 0.5) < 0.08 THEN 'symmetry'
 WHEN abs(main_x - 0.5) < 0.07 THEN 'center'
 WHEN least(abs(main_x - 1.0/3.0), abs(main_x - 2.0/3.0)) < 0.09 THEN 'thirds' ELSE 'leading_space' END AS composition
FROM g""")
def _(spark, sf):
    ls = B.order_shots(spark, sf).withColumn("x", F.col("l_quantity") / 50.0)
    g = ls.groupBy("plan").agg(F.min_by("x", "shot_idx").alias("main_x"),
                               F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("plan", S.classify_composition(F.col("main_x"), F.col("xs")).alias("composition"))


CAM = {"px": "l_quantity * 20", "py": "(l_discount - 0.05) * 6000", "pz": "l_tax * 2500",
       "pitch": "l_linenumber * 3.0 - 12", "yaw": "(l_suppkey % 40) - 20.0", "roll": "(l_partkey % 11) - 5.0"}
SQL_AXES = """ax AS (SELECT *, sin(radians(pitch)) sp, cos(radians(pitch)) cp, sin(radians(yaw)) sy, cos(radians(yaw)) cy,
 sin(radians(roll)) sr, cos(radians(roll)) cr FROM cam)"""
SQL_LOCAL = """lo AS (SELECT *, px*cp*cy + py*cp*sy + pz*sp AS depth,
 px*(sr*sp*cy - cr*sy) + py*(sr*sp*sy + cr*cy) - pz*sr*cp AS across,
 -px*(cr*sp*cy + sr*sy) + py*(cy*sr - cr*sp*sy) + pz*cr*cp AS above FROM ax)"""


@query("e4_project_to_screen", f"""WITH cam AS (SELECT {LK}, 20.0 + l_quantity AS lens,
 {', '.join(f'{v} AS {k}' for k, v in CAM.items())} FROM lineitem), {SQL_AXES}, {SQL_LOCAL}
SELECT {LK}, CASE WHEN depth > 1e-4 THEN round(0.5 + 0.5 * (across / depth) / (36.0 / (2 * lens)), 6) END AS screen_x,
 CASE WHEN depth > 1e-4 THEN round(0.5 - 0.5 * (above / depth) / (36.0 / 1.5 / (2 * lens)), 6) END AS screen_y FROM lo""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    e = {k: F.expr(v) for k, v in CAM.items()}
    axes = S.camera_axes(e["pitch"], e["yaw"], e["roll"])
    zero = (F.lit(0.0),) * 3
    x, y = S.project_to_screen(zero, axes, (e["px"], e["py"], e["pz"]), F.col("l_quantity") + 20.0, F.lit(1.5))
    return li.select(*LINE_KEYS, r6(x).alias("screen_x"), r6(y).alias("screen_y"))


@query("e5_screen_delta_to_degrees", f"""SELECT {LK}, round(greatest(1, l_linenumber) * degrees(atan((l_quantity / 100 - 0.25)
 / greatest(1, l_linenumber) * 2 * (36.0 / (greatest(1.0, l_extendedprice / 1000) * 2)))), 6) AS deg FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    deg = S.screen_delta_to_degrees(F.col("l_quantity") / 100 - 0.25, F.col("l_extendedprice") / 1000,
                                    F.lit(36.0), F.col("l_linenumber"))
    return li.select(*LINE_KEYS, r6(deg).alias("deg"))


@query("e6_shot_distance", f"""WITH {SQL_LINES}, a AS (SELECT *, greatest(30.0, l_quantity * 8) AS body,
 {sql_case('size', C.LENS_MM)}::DOUBLE AS fl, {sql_case('size', C.VISIBLE_RATIO)}::DOUBLE AS vis,
 {sql_case('size', C.FOCUS_RATIO)}::DOUBLE AS foc FROM li),
b AS (SELECT *, greatest(50.0, least(10000.0, body * vis * fl / (36.0 / greatest(0.25, least(4.0, aspect))
 * greatest(0.05, least(1.0, l_discount * 12))))) AS d FROM a)
SELECT {LK}, round(d, 6) AS distance_cm, round(greatest(-5000.0, least(5000.0, CASE angle
 WHEN 'low' THEN -least(d * tan(radians(15.0)), greatest(0.0, body * foc - 20.0))
 WHEN 'high' THEN d * tan(radians(25.0)) WHEN 'overhead' THEN d * tan(radians(60.0)) ELSE 0.0 END)), 6) AS height_cm,
 CASE WHEN angle = 'dutch' THEN CASE WHEN l_quantity / 50 < 0.5 THEN -10.0 ELSE 10.0 END ELSE 0.0 END::DOUBLE AS camera_roll FROM b""")
def _(spark, sf):
    out = S.shot_framing(F.col("size"), F.col("angle"), F.col("l_quantity") * 8, F.col("l_discount") * 12,
                         F.col("aspect"), F.col("l_quantity") / 50)
    return lines(spark, sf).select(*LINE_KEYS, r6(out["distance_cm"]).alias("distance_cm"),
                                   r6(out["height_cm"]).alias("height_cm"), out["camera_roll"].alias("camera_roll"))


@query("e7_infer_labels", f"""WITH {SQL_LINES}, a AS (SELECT *, l_extendedprice / 105000 AS foc,
 CASE WHEN l_partkey % 7 = 0 THEN 5.0 ELSE 0.0 END AS roll FROM li)
SELECT {LK}, CASE WHEN foc >= 0.9 THEN 'extreme_close_up' WHEN foc >= 0.8 THEN 'close_up' WHEN foc >= 0.6 THEN 'medium'
 WHEN lens <= 32 THEN 'wide' ELSE 'full' END AS shot_size,
 CASE WHEN abs(roll) > 1 THEN 'dutch' ELSE CASE WHEN e > 45 THEN 'overhead' WHEN e > 12 THEN 'high' WHEN e < -5 THEN 'low' ELSE 'eye' END END AS camera_angle
FROM (SELECT *, degrees(atan2(height, greatest(1.0, sqrt(distance*distance + side*side)))) AS e FROM a)""")
def _(spark, sf):
    roll = F.when(F.col("l_partkey") % 7 == 0, 5.0).otherwise(F.lit(0.0))
    return lines(spark, sf).select(
        *LINE_KEYS, S.infer_shot_size(F.col("l_extendedprice") / 105000, F.col("lens")).alias("shot_size"),
        S.infer_camera_angle(F.col("distance"), F.col("side"), F.col("height"), roll).alias("camera_angle"))


@query("e8_motion_end_state", f"""WITH {SQL_LINES}, a AS (SELECT *, l_linestatus = 'O' AS has, (l_discount - 0.05) * 4 AS dx,
 (l_tax - 0.04) * 5 AS dy, 0.5 + l_discount * 10 AS bg, l_tax * 25 AS subj, l_discount * 3 AS path,
 36.0 / (greatest(1.0, lens) * 2) AS th, 36.0 / greatest(0.25, least(4.0, aspect)) / (greatest(1.0, lens) * 2) AS tv FROM li)
SELECT {LK},
 round(CASE WHEN motion IN ('dolly_in', 'dolly_out') THEN CASE WHEN has AND subj > 0.05 THEN greatest(20.0, distance / subj)
   ELSE distance * CASE WHEN motion = 'dolly_in' THEN 0.65 ELSE 1.4 END END ELSE distance END, 6) AS end_distance,
 round(side + CASE WHEN motion IN ('truck_left', 'truck_right', 'tracking') THEN
   (CASE WHEN motion = 'truck_left' THEN -1 ELSE 1 END) * CASE WHEN has AND abs(dx) * distance * 2 * th > 1
     THEN abs(dx) * distance * 2 * th ELSE greatest(100.0, distance * 0.35) END
   WHEN motion = 'orbit' THEN greatest(150.0, distance * 0.65) ELSE 0 END, 6) AS end_side,
 round(height + CASE WHEN motion = 'pedestal' THEN CASE WHEN has AND abs(dy) * distance * 2 * tv > 1
   THEN abs(dy) * distance * 2 * tv ELSE greatest(100.0, distance * 0.25) END ELSE 0 END, 6) AS end_height,
 round(CASE WHEN motion IN ('zoom_in', 'zoom_out') THEN greatest(8.0, least(200.0, lens * CASE WHEN has AND bg > 0.05 THEN bg
   WHEN motion = 'zoom_in' THEN 1.45 ELSE 0.72 END)) ELSE lens END, 6) AS end_lens,
 round(CASE WHEN motion = 'pan' THEN CASE WHEN has THEN -(l_linenumber * degrees(atan(dx / l_linenumber * 2 * th))) ELSE 25.0 END
   WHEN motion = 'handheld' THEN 2.0 * CASE WHEN has THEN greatest(0.3, least(3.0, path / 0.15)) ELSE 1.0 END ELSE 0.0 END, 6) AS yaw_delta,
 round(CASE WHEN motion = 'tilt' THEN CASE WHEN has THEN l_linenumber * degrees(atan(dy / l_linenumber * 2 * tv)) ELSE -18.0 END
   WHEN motion = 'handheld' THEN -1.5 * CASE WHEN has THEN greatest(0.3, least(3.0, path / 0.15)) ELSE 1.0 END ELSE 0.0 END, 6) AS pitch_delta,
 {', '.join(f"round(CASE WHEN motion = 'handheld' THEN {cm} * CASE WHEN has THEN greatest(0.3, least(3.0, path / 0.15)) ELSE 1.0 END ELSE 0.0 END, 6) AS {n}" for n, cm in (('roll_delta', 0.8), ('move_x', 8.0), ('move_y', 12.0), ('move_z', 6.0)))}
FROM a""")
def _(spark, sf):
    li = lines(spark, sf)
    out = S.motion_end_state(
        F.col("motion"), F.col("distance"), F.col("side"), F.col("height"), F.col("lens"), F.col("aspect"),
        F.col("l_linestatus") == "O", (F.col("l_discount") - 0.05) * 4, (F.col("l_tax") - 0.04) * 5,
        0.5 + F.col("l_discount") * 10, F.col("l_tax") * 25, F.col("l_discount") * 3, F.col("l_linenumber"))
    return li.select(*LINE_KEYS, *[r6(v).alias(k) for k, v in out.items()])


@query("e9_offset_decompose", f"""WITH {B.FR}, v AS (SELECT vec_id, sig[1] ax, sig[2] ay, sig[3] az, sig[4] fx, sig[5] fy,
 sig[6] cx, sig[7] cy, sig[8] cz FROM fr),
b AS (SELECT *, fx / sqrt(fx*fx + fy*fy) ux, fy / sqrt(fx*fx + fy*fy) uy FROM v),
d AS (SELECT *, (cx-ax)*ux + (cy-ay)*uy AS distance, -(cx-ax)*uy + (cy-ay)*ux AS side, cz - az AS height FROM b)
SELECT vec_id, round(distance, 6) AS distance, round(side, 6) AS side, round(height, 6) AS height,
 round(abs(ax + ux*distance - uy*side - cx) + abs(ay + uy*distance + ux*side - cy), 6) AS inverse_error FROM d""")
def _(spark, sf):
    fr = B.frames(spark, sf)
    s = [F.get("sig", F.lit(i)) for i in range(8)]
    n = F.sqrt(s[3] * s[3] + s[4] * s[4])
    forward, right = (s[3] / n, s[4] / n, F.lit(0.0)), (-s[4] / n, s[3] / n, F.lit(0.0))
    delta = (s[5] - s[0], s[6] - s[1], s[7] - s[2])
    d, w = S.dot(delta, forward), S.dot(delta, right)
    back = [s[i] + forward[i] * d + right[i] * w for i in range(2)]
    return fr.select("vec_id", r6(d).alias("distance"), r6(w).alias("side"), r6(delta[2]).alias("height"),
                     r6(F.abs(back[0] - s[5]) + F.abs(back[1] - s[6])).alias("inverse_error"))


SQL_USABLE = """list_filter([0,1,2,3,4,5,6,11,12,13,14,15,16], lambda j: kp[j+1].score >= CASE WHEN j >= 13 THEN greatest({t}, 0.5) ELSE {t} END
 AND kp[j+1].x >= 1280*0.03 AND kp[j+1].x <= 1280 - 1280*0.03 AND kp[j+1].y >= 720*0.04
 AND kp[j+1].y <= 720 - 720 * CASE WHEN j >= 11 THEN 0.06 ELSE 0.04 END)"""


@query("f6_usable_keypoints", f"""WITH {B.KP} SELECT vec_id, array_to_string({SQL_USABLE.format(t=0.35)}, ',') AS usable FROM kp""")
def _(spark, sf):
    kp = B.keypoints(spark, sf)
    return kp.select("vec_id", F.array_join(K.usable_keypoints(F.col("kp"), 0.35, 1280, 720).cast("array<string>"),
                                            ",").alias("usable"))


@query("e10_axis_tilt_confirmed", f"""WITH {B.KP}, u AS (SELECT vec_id, kp, kp[7].x - kp[8].x AS bx, kp[9].y - kp[10].y AS by_,
 {SQL_USABLE.format(t=0.2)} AS vis FROM kp), t AS (SELECT *, degrees(atan2(abs(bx), -by_)) AS tilt,
 kp[6].x - kp[7].x AS sx, kp[6].y - kp[7].y AS sy, kp[12].x - kp[13].x AS hx, kp[12].y - kp[13].y AS hy FROM u)
SELECT vec_id, round(tilt, 6) AS tilt, tilt >= 35 AND tilt <= 135 AND
 CASE WHEN list_contains(vis, 5) AND list_contains(vis, 6) AND sqrt(sx*sx + sy*sy) >= 6
   THEN abs(least(tilt, 180 - tilt) - degrees(atan2(abs(sy), abs(sx)))) <= 25
  WHEN list_contains(vis, 11) AND list_contains(vis, 12) AND sqrt(hx*hx + hy*hy) >= 6
   THEN abs(least(tilt, 180 - tilt) - degrees(atan2(abs(hy), abs(hx)))) <= 25 ELSE false END AS confirmed FROM t""")
def _(spark, sf):
    kp = B.keypoints(spark, sf).withColumn("vis", K.usable_keypoints(F.col("kp"), 0.2, 1280, 720))
    p = [F.get("kp", F.lit(i)) for i in range(17)]
    bx, by = p[6]["x"] - p[7]["x"], p[8]["y"] - p[9]["y"]
    return kp.select("vec_id", r6(K.axis_tilt_degrees(bx, by)).alias("tilt"),
                     K.tilt_confirmed(F.col("kp"), F.col("vis"), bx, by).alias("confirmed"))


SQL_BHATTA = "sqrt(greatest(0.0, 1 - list_sum(list_transform(range(1, {n}), lambda i: sqrt({a}[i]*{b}[i]))) / sqrt(list_sum({a})*list_sum({b}))))"


@query("e11_histogram_distance", f"""WITH {B.FR}, h AS (SELECT vec_id, list_transform(sig[1:54], lambda x: abs(x)) AS c,
 list_transform(sig[55:64], lambda x: abs(x)) AS v FROM fr),
p AS (SELECT h.vec_id, h.c, h.v, g.c AS c2, g.v AS v2 FROM h JOIN h g ON g.vec_id = h.vec_id + 1)
SELECT vec_id, round(0.6 * {SQL_BHATTA.format(n=55, a='c', b='c2')} + 0.4 * {SQL_BHATTA.format(n=11, a='v', b='v2')}, 6) AS distance FROM p""")
def _(spark, sf):
    h = B.frames(spark, sf).select("vec_id", F.transform("sig", F.abs).alias("h"))
    g = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h2"))
    return h.join(g, "vec_id").select("vec_id", r6(V.histogram_distance(F.col("h"), F.col("h2"), 54)).alias("distance"))


@query("e12_signature_distance", f"""WITH {B.FR}, s AS (SELECT vec_id, list_transform(range(0, 21), lambda j:
 {{'r': abs(sig[j*3+1]), 'g': abs(sig[j*3+2]), 'b': abs(sig[j*3+3])}}) AS a FROM fr),
p AS (SELECT s.vec_id, s.a, n.a AS b FROM s LEFT JOIN s n ON n.vec_id = s.vec_id + 1)
SELECT vec_id, CASE WHEN b IS NULL THEN 1.0 ELSE round(least(1.0, list_sum(list_transform(range(1, 22), lambda i:
 0.7 * (abs(a[i].r-b[i].r) + abs(a[i].g-b[i].g) + abs(a[i].b-b[i].b)) / 3
 + 0.3 * abs((a[i].r*0.3 + a[i].g*0.59 + a[i].b*0.11) - (b[i].r*0.3 + b[i].g*0.59 + b[i].b*0.11)))) / 21), 6) END AS distance FROM p""")
def _(spark, sf):
    cells = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.struct(
        F.abs(F.get("sig", j * 3)).alias("r"), F.abs(F.get("sig", j * 3 + 1)).alias("g"),
        F.abs(F.get("sig", j * 3 + 2)).alias("b")))
    s = B.frames(spark, sf).select("vec_id", cells.alias("a"))
    n = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return s.join(n, "vec_id", "left").select(
        "vec_id", r6(F.coalesce(V.signature_distance(F.col("a"), F.col("b")), F.lit(1.0))).alias("distance"))


SQL_ANGLE = ("CASE WHEN {na} > 1e-6 AND {nb} > 1e-6 THEN degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ({na} * {nb}))))) END")


def sql_angle(a: list[str], b: list[str]) -> str:
    na = "sqrt(" + " + ".join(f"{x}*{x}" for x in a) + ")"
    nb = "sqrt(" + " + ".join(f"{x}*{x}" for x in b) + ")"
    return SQL_ANGLE.format(na=na, nb=nb, dot=" + ".join(f"{x}*{y}" for x, y in zip(a, b)))


@query("e13_vector_angle_deg", f"""WITH {B.FR} SELECT vec_id, round({sql_angle(['sig[1]', 'sig[2]', 'sig[3]'], ['sig[4]', 'sig[5]', 'sig[6]'])}, 6) AS deg FROM fr""")
def _(spark, sf):
    s = [F.get("sig", F.lit(i)) for i in range(6)]
    return B.frames(spark, sf).select("vec_id", r6(V.vector_angle_deg(s[:3], s[3:])).alias("deg"))


SQL_Q = "list_transform({s}, lambda x: x / sqrt(list_sum(list_transform({s}, lambda y: y*y))))"


@query("e14_quaternion_angle_deg", f"""WITH {B.FR}, q AS (SELECT vec_id, {SQL_Q.format(s='sig[1:4]')} a, {SQL_Q.format(s='sig[5:8]')} b FROM fr)
SELECT vec_id, round(degrees(2 * acos(least(1.0, abs(a[1]*b[1] + a[2]*b[2] + a[3]*b[3] + a[4]*b[4])))), 6) AS deg FROM q""")
def _(spark, sf):
    s = [F.get("sig", F.lit(i)) for i in range(8)]
    return B.frames(spark, sf).select(
        "vec_id", r6(V.quaternion_angle_deg(V.unit4(s[:4]), V.unit4(s[4:]))).alias("deg"))


TOKENS = ["ring", "blue_rod", "gear", "large"]
SQL_NORM = "replace(replace(replace(replace(replace(lower({x}), 'mixamorig:', ''), 'bip001', ''), '.', '_'), '-', '_'), ' ', '_')"


@query("e15_bone_name_score", "WITH n AS (SELECT p_partkey, " + SQL_NORM.format(x="p_name") + """ AS n FROM part)
SELECT p_partkey, greatest(""" + ", ".join(
    f"CASE WHEN n = '{t}' THEN 0.70 WHEN ends_with(n, '_{t}') OR starts_with(n, '{t}_') THEN 0.64 "
    f"WHEN contains(n, '{t}') THEN 0.56 ELSE 0.0 END" for t in TOKENS) + ")::DOUBLE AS score FROM n")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.bone_name_score(F.col("p_name"), TOKENS).alias("score"))


@query("e17_aux_bone_class", "WITH n AS (SELECT p_partkey, " + SQL_NORM.format(
    x="CASE p_partkey % 6 WHEN 0 THEN 'Bip001 ' || p_name || '_Twist' WHEN 1 THEN 'l_' || p_name WHEN 2 THEN p_name || '.index01' "
      "WHEN 3 THEN 'mixamorig:LeftEye' WHEN 4 THEN 'RigLArm' || p_name ELSE p_name END") + """ AS n FROM part)
SELECT p_partkey, regexp_matches(n, 'twist|roll|torsion') AS is_twist,
 regexp_matches(n, 'thumb|index|middle|ring|pinky|little') AS is_finger,
 regexp_matches(n, 'jaw|eye|brow|lid|lip|mouth|cheek|nose|tongue') AS is_face,
 regexp_matches(n, 'left|^l_|_l$|riglarm|riglleg|_larm|_lleg|flleg|blleg|lfrontleg|lbackleg|llegfront|llegback') AS is_left FROM n""")
def _(spark, sf):
    p = table(spark, sf, "part")
    m = F.col("p_partkey") % 6
    name = (F.when(m == 0, F.concat(F.lit("Bip001 "), "p_name", F.lit("_Twist"))).when(m == 1, F.concat(F.lit("l_"), "p_name"))
            .when(m == 2, F.concat("p_name", F.lit(".index01"))).when(m == 3, "mixamorig:LeftEye")
            .when(m == 4, F.concat(F.lit("RigLArm"), "p_name")).otherwise(F.col("p_name")))
    return p.select("p_partkey", *[v.alias(k) for k, v in T.aux_bone_class(name).items()])


PHRASE = {"signup": "Wide establishing shot", "view": "full body at eye-level", "click": "medium two-shot, handheld",
          "purchase": "low angle close-up with push in", "error": "over-the-shoulder Dialogue by the harbour"}
# ASCII part of the split rule: RE2 has no lookahead, and the phrases hold no Hangul.
SQL_SPLIT = r"(?i)->|→|⇒|,|，|;|\bthen\b|\bfinally\b|\bafter\s+that\b"
SQL_PROMPTS = B.EV + f""", pr AS (SELECT reel, string_agg({sql_case('event_type', {k: repr(v) for k, v in PHRASE.items()})}, ' then ' ORDER BY i) AS prompt
 FROM ev GROUP BY reel)"""


def prompts(spark, sf):
    """One written request per reel, from all its events in order."""
    ev = B.event_series(spark, sf)
    said = ev.select("reel", "i", B.literal_map(PHRASE)[F.col("event_type")].alias("p"))
    return said.groupBy("reel").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]), " then ").alias("prompt"))


@query("e18_split_clauses", rf"""WITH {SQL_PROMPTS}, tx AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || reel, prompt FROM pr),
c AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '{SQL_SPLIT}'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS cs FROM tx)
SELECT id, generate_subscripts(cs, 1) - 1 AS ord, md5(unnest(cs)) AS clause FROM c""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    p = prompts(spark, sf).select(F.concat(F.lit("p"), "reel").alias("id"), F.col("prompt").alias("text"))
    both = d.unionByName(p).select("id", F.posexplode(T.split_clauses(F.col("text"))).alias("ord", "clause"))
    return both.select("id", F.col("ord").cast("bigint").alias("ord"), F.md5("clause").alias("clause"))


def sql_first(expr: str, patterns) -> str:
    ascii_only = [("|".join(a for a in p.split("|") if a.isascii()), v) for p, v in patterns]
    return "CASE " + " ".join("WHEN regexp_matches({0}, '(?i){1}') THEN '{2}'".format(expr, p.replace("'", "''"), v)
                              for p, v in ascii_only) + " END"


SQL_CLAUSES = rf"""{SQL_PROMPTS}, cl AS (SELECT reel, generate_subscripts(cs, 1) - 1 AS ord, unnest(cs) AS clause FROM (SELECT reel,
 list_filter(list_transform(regexp_split_to_array(prompt, '{SQL_SPLIT}'), lambda x: trim(x)), lambda x: x <> '') AS cs FROM pr))"""


@query("e19_first_match_label", f"""WITH {SQL_CLAUSES}, m AS (SELECT reel, ord, {sql_first('clause', C.SIZE_PATTERNS)} AS size, {sql_first('clause', C.ANGLE_PATTERNS)} AS angle,
 {sql_first('clause', C.MOTION_PATTERNS)} AS motion, {sql_first('clause', C.PEOPLE_PATTERNS)} AS p FROM cl)
SELECT reel, ord, CASE WHEN p = 'ots' THEN coalesce(size, 'medium') ELSE size END AS size, angle, motion,
 CASE WHEN p = 'ots' THEN 1 ELSE p::INT END AS people, coalesce(p = 'ots', false) AS ots FROM m""")
def _(spark, sf):
    cl = prompts(spark, sf).select("reel", F.posexplode(T.split_clauses(F.col("prompt"))).alias("ord", "clause"))
    return cl.select("reel", F.col("ord").cast("bigint").alias("ord"),
                     *[v.alias(k) for k, v in T.request_of(F.col("clause")).items()])


SQL_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS if w.isascii())


def sql_text(expr: str, patterns) -> str:
    ascii_only = ["|".join(a for a in p.split("|") if a.isascii()).replace("'", "''") for p, _ in patterns]
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, '(?i){p}') THEN regexp_extract({expr}, '(?i){p}')"
                              for p in ascii_only) + " END"


@query("e20_residual_keywords", rf"""WITH {SQL_PROMPTS}, tx AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || reel, prompt FROM pr),
us AS (SELECT id, text, list_filter(flatten(list_transform(list_transform(regexp_split_to_array(text, '{SQL_SPLIT}'), lambda x: trim(x)), lambda c:
 [{sql_text('c', C.SIZE_PATTERNS)}, {sql_text('c', C.ANGLE_PATTERNS)}, {sql_text('c', C.MOTION_PATTERNS)}, {sql_text('c', C.PEOPLE_PATTERNS)}])),
 lambda u: u IS NOT NULL) AS used FROM tx),
re AS (SELECT id, list_reduce(used, lambda a, u: replace(a, u, ' '), text) AS rest FROM us)
SELECT id, md5(array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(rest, '{SQL_SPLIT}', ' ', 'g')), '[0-9A-Za-z가-힣]{{2,}}'),
 lambda w: NOT list_contains([{SQL_STOP}], w)), ' ')) AS keywords FROM re""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    p = prompts(spark, sf).select(F.concat(F.lit("p"), "reel").alias("id"), F.col("prompt").alias("text"))
    words = T.residual_keywords(F.col("text"), T.understood_phrases(F.col("text")))
    return d.unionByName(p).select("id", F.md5(F.array_join(words, " ")).alias("keywords"))


CLOCK = "CASE event_id % 5 WHEN 0 THEN k || ':' || (event_id % 60) || '-' || (k + 1) || ':30' WHEN 1 THEN k || '-' || (event_id % 100) || '.5' WHEN 2 THEN '1:' || k || ':05 - 1:' || (k + 2) || ':05' WHEN 3 THEN '' ELSE 'from ' || k END"
SQL_CLOCK = ("CASE WHEN len({p}) <= 3 AND len(list_filter({p}, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 THEN "
             "list_reduce(list_transform({p}, lambda x: CAST(x AS DOUBLE)), lambda a, x: a*60 + x) END")


@query("e21_parse_clock", rf"""WITH {B.EV}, c AS (SELECT event_id, trim({CLOCK}) AS s FROM ev),
g AS (SELECT *, regexp_extract(s, '^([\d:.]+)\s*-\s*([\d:.]+)$', ['a', 'b']) AS m, regexp_matches(s, '^[\d:.]+\s*-\s*[\d:.]+$') AS ok FROM c),
v AS (SELECT event_id, s, ok, CASE WHEN ok THEN {SQL_CLOCK.format(p="string_split(m.a, ':')")} END AS st, CASE WHEN ok THEN {SQL_CLOCK.format(p="string_split(m.b, ':')")} END AS en FROM g),
e AS (SELECT *, CASE WHEN s = '' THEN NULL WHEN NOT ok THEN 'format' WHEN st IS NULL OR en IS NULL THEN 'time' WHEN en <= st THEN 'order' END AS error FROM v)
SELECT event_id, CASE WHEN s <> '' AND error IS NULL THEN st END AS section_start, CASE WHEN s <> '' AND error IS NULL THEN en END AS section_end, error FROM e""")
def _(spark, sf):
    ev = B.event_series(spark, sf)
    return ev.select("event_id", *[v.alias(n) for n, v in T.parse_section(F.expr(CLOCK)).items()])


@query("e22_safe_title", r"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 60), ''), 'LinkReference') AS title FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.safe_title(F.col("text")).alias("title"))


@query("e23_fingerprint", """SELECT o_orderkey, md5(concat_ws('|', '/lib/' || o_orderkey || '.mp4', o_custkey, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate), 'sig-1')) AS fingerprint FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    when = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    return o.select("o_orderkey", T.fingerprint(
        F.concat(F.lit("/lib/"), "o_orderkey", F.lit(".mp4")), F.col("o_custkey").cast("string"),
        when.cast("string"), F.lit("sig-1")).alias("fingerprint"))


@query("e24_position_size_score", f"""SELECT {LK}, round(100.0 * (0.5 * greatest(0.0, 1 - l_discount / 0.15) + 0.5 * CASE WHEN l_tax = 0 THEN 0.5
 ELSE greatest(0.0, 1 - abs(ln(l_tax * 25)) / ln(1.5)) END), 6) AS score FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS, r6(S.position_size_score(F.col("l_discount"), F.col("l_tax") * 25)).alias("score"))


@query("e25_composition_risk", f"""WITH {SQL_LINES}, a AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_tax * 8 - 0.1 END AS hy,
 l_quantity / 40 - 0.1 AS hx, l_tax * 8 - 0.1 + l_discount * 8 AS fy, l_extendedprice / 105000 AS foc FROM li),
r AS (SELECT *, [CASE WHEN hy IS NULL THEN 'behind camera' END, CASE WHEN hy < 0 AND foc < 0.8 THEN 'head cut' END,
 CASE WHEN hy >= 0 AND hy < 0.03 THEN 'low headroom' END, CASE WHEN hy IS NOT NULL AND fy - hy < 0.08 THEN 'too small' END,
 CASE WHEN hy IS NOT NULL AND (hx < -0.05 OR hx > 1.05) THEN 'off screen' END, CASE WHEN abs(side) > distance * 0.8 THEN 'side offset' END] AS w FROM a),
s AS (SELECT *, least(100, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN w[i] IS NULL THEN 0 ELSE ([60,45,15,25,30,15])[i] END)))::INT AS risk FROM r)
SELECT {LK}, risk, CASE WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 30 THEN 'CHECK' ELSE 'LOW' END AS grade, array_to_string(list_filter(w, lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def _(spark, sf):
    li = lines(spark, sf)
    hy = F.when(F.col("l_partkey") % 9 != 0, F.col("l_tax") * 8 - 0.1)
    risk, grade, reasons = S.composition_risk(
        F.col("l_quantity") / 40 - 0.1, hy, F.col("l_tax") * 8 - 0.1 + F.col("l_discount") * 8,
        F.col("l_extendedprice") / 105000, F.col("side"), F.col("distance"))
    return li.select(*LINE_KEYS, risk.alias("risk"), grade.alias("grade"), F.array_join(reasons, ",").alias("reasons"))


@query("e27_correction_step", f"""WITH {SQL_LINES}, a AS (SELECT *, l_linestatus = 'O' AS ots, l_tax * 25 AS ratio, (l_discount - 0.05) * 2 AS ex, (l_tax - 0.04) AS ey,
 CASE WHEN size IN ('close_up', 'extreme_close_up') THEN 0.5 ELSE 0.8 END * CASE WHEN l_linenumber > 4 THEN 0.5 ELSE 1.0 END AS gain FROM li),
f AS (SELECT *, CASE WHEN ratio > 0.05 THEN greatest(0.75, least(1.33, pow(ratio, gain))) ELSE 1.0 END AS factor FROM a)
SELECT {LK}, round(CASE WHEN ots OR ratio <= 0.05 THEN distance ELSE greatest(30.0, least(10000.0, distance * factor)) END, 6) AS new_distance,
 round(CASE WHEN ots AND ratio > 0.05 THEN greatest(8.0, least(200.0, lens / factor)) ELSE lens END, 6) AS new_lens,
 round(greatest(0.02, least(0.98, l_quantity / 50 - ex * gain)), 6) AS new_x, round(greatest(0.02, least(0.98, 0.5 - ey * gain)), 6) AS new_y FROM f""")
def _(spark, sf):
    out = S.correction_step(
        F.col("distance"), F.col("lens"), F.col("l_quantity") / 50, F.lit(0.5), (F.col("l_discount") - 0.05) * 2,
        F.col("l_tax") - 0.04, F.col("l_tax") * 25, F.col("size"),
        F.when(F.col("l_linenumber") > 4, 0.5).otherwise(1.0), F.col("l_linestatus") == "O")
    return lines(spark, sf).select(*LINE_KEYS, *[r6(v).alias(k) for k, v in out.items()])
