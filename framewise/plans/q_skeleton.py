"""Skeletons over the bound tables: every 64 parts are one mesh, a binary tree of bones."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import shot as S
from framewise.functions import text as T
from framewise.functions import vectors as V
from framewise.operators import scorecards as SC
from framewise.operators import skeleton as H
from framewise.plans import bindings as B
from framewise.plans.q_functions import SQL_NORM, r6
from framewise.plans.registry import query, table

SUFFIX = ["_twist_01", "_index1", "_metacarpal", "", "_l", "_thumb_r", "", "_roll"]
BASE = ["pelvis", "spine_01", "neck", "head", "clavicle_l", "upperarm_l", "lowerarm_l", "hand_l", "thigh_r", "calf_r", "foot_r"]


def bones(spark, sf):
    p = table(spark, sf, "part")
    k, i = F.col("p_partkey"), F.col("p_partkey") % 64
    raw = [F.col("p_size") % 5 - 2.0, k % 3 - 1.0, F.lit(1.0), F.lit(3.0)]
    q = V.unit4(raw)
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), c.cast("int"))
    name = F.concat(F.when(k % 3 == 0, pick(BASE, k % 11)).otherwise(F.col("p_name")), pick(SUFFIX, k % 8))
    return p.select(
        F.floor(k / 64).alias("mesh"), i.alias("bone_idx"), F.when(i > 0, F.floor((i - 1) / 2)).cast("bigint").alias("parent_idx"), name.alias("name"),
        (F.col("p_size") % 7 - 3.0).alias("x"), (k % 5 - 2.0).alias("y"), F.when(k % 4 == 0, 0.0).otherwise(F.lit(9.0)).alias("z"),
        *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))])


SQL_BONES = f"""b0 AS (SELECT p_partkey // 64 AS mesh, p_partkey % 64 AS bone_idx, CASE WHEN p_partkey % 64 > 0 THEN (p_partkey % 64 - 1) // 2 END AS parent_idx,
 CASE WHEN p_partkey % 3 = 0 THEN ({BASE})[p_partkey % 11 + 1] ELSE p_name END || ({SUFFIX})[p_partkey % 8 + 1] AS name, p_size % 7 - 3.0::DOUBLE AS x, p_partkey % 5 - 2.0::DOUBLE AS y, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 9.0 END::DOUBLE AS z,
 p_size % 5 - 2.0::DOUBLE AS qx, p_partkey % 3 - 1.0::DOUBLE AS qy, 1.0::DOUBLE AS qz, 3.0::DOUBLE AS qw FROM part),
bo AS (SELECT * REPLACE (qx / n AS qx, qy / n AS qy, qz / n AS qz, qw / n AS qw) FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM b0))"""
SQL_CLOSURE = SQL_BONES + """, cl AS (SELECT mesh, bone_idx, parent_idx AS ancestor, 1::BIGINT AS distance FROM bo WHERE parent_idx IS NOT NULL
 UNION ALL SELECT cl.mesh, cl.bone_idx, bo.parent_idx, cl.distance + 1 FROM cl JOIN bo ON bo.mesh = cl.mesh AND bo.bone_idx = cl.ancestor WHERE bo.parent_idx IS NOT NULL)"""


def _rot(q: str, v: list[str]) -> list[str]:
    """SQL of a vector turned by quaternion fields of alias q."""
    x, y, z, w = (f"{q}.q{c}" for c in "xyzw")
    t = [f"(2*({y}*{v[2]} - {z}*{v[1]}))", f"(2*({z}*{v[0]} - {x}*{v[2]}))", f"(2*({x}*{v[1]} - {y}*{v[0]}))"]
    return [f"({v[0]} + {w}*{t[0]} + {y}*{t[2]} - {z}*{t[1]})", f"({v[1]} + {w}*{t[1]} + {z}*{t[0]} - {x}*{t[2]})", f"({v[2]} + {w}*{t[2]} + {x}*{t[1]} - {y}*{t[0]})"]


_R = _rot("c", ["b.x", "b.y", "b.z"])
SQL_POSE = SQL_BONES + f""", cp AS (SELECT mesh, bone_idx, x, y, z, qx, qy, qz, qw FROM bo WHERE parent_idx IS NULL
 UNION ALL SELECT b.mesh, b.bone_idx, c.x + {_R[0]}, c.y + {_R[1]}, c.z + {_R[2]}, c.qw*b.qx + c.qx*b.qw + c.qy*b.qz - c.qz*b.qy, c.qw*b.qy - c.qx*b.qz + c.qy*b.qw + c.qz*b.qx,
 c.qw*b.qz + c.qx*b.qy - c.qy*b.qx + c.qz*b.qw, c.qw*b.qw - c.qx*b.qx - c.qy*b.qy - c.qz*b.qz FROM cp c JOIN bo b ON b.mesh = c.mesh AND b.parent_idx = c.bone_idx)"""


@query("h1_component_pose", f"WITH RECURSIVE {SQL_POSE} SELECT mesh, bone_idx, {', '.join(f'round({c}, 6) AS {c}' for c in H.POSE)} FROM cp")
def _(spark, sf):
    return H.component_pose(bones(spark, sf)).select("mesh", "bone_idx", *[r6(F.col(c)).alias(c) for c in H.POSE])


@query("h2_hierarchy_stats", f"""WITH RECURSIVE {SQL_CLOSURE}, d AS (SELECT mesh, bone_idx, max(distance) AS depth FROM cl GROUP BY ALL), n AS (SELECT mesh, ancestor AS bone_idx, count(*) AS descendants, count(*) FILTER (WHERE distance = 1) AS children FROM cl GROUP BY ALL)
SELECT bo.mesh, bo.bone_idx, coalesce(depth, 0)::INT AS depth, coalesce(descendants, 0) AS descendants, coalesce(children, 0) AS children FROM bo LEFT JOIN d USING (mesh, bone_idx) LEFT JOIN n USING (mesh, bone_idx)""")
def _(spark, sf):
    return H.hierarchy_stats(bones(spark, sf))


@query("h2_ancestor_closure", f"WITH RECURSIVE {SQL_CLOSURE} SELECT mesh, bone_idx, ancestor, distance FROM cl")
def _(spark, sf):
    return H.closure(bones(spark, sf))


SQL_PLACED = SQL_POSE + f""", pn AS (SELECT cp.mesh, cp.bone_idx, cp.x, cp.y, cp.z, {SQL_NORM.format(x='bo.name')} AS nm FROM cp JOIN bo USING (mesh, bone_idx)),
bx AS (SELECT mesh, min(z) AS lz, max(z) AS hz, max(y) - min(y) >= max(x) - min(x) AS ay, CASE WHEN max(y) - min(y) >= max(x) - min(x) THEN (max(y) + min(y)) / 2 ELSE (max(x) + min(x)) / 2 END AS mid, greatest(1.0, greatest(max(y) - min(y), max(x) - min(x)) * 0.5) AS half FROM pn GROUP BY mesh),
lf AS (SELECT mesh, CASE WHEN count(*) > 0 AND sum(CASE WHEN ay THEN y - mid ELSE x - mid END) >= 0 THEN 1 ELSE -1 END AS ls FROM pn JOIN bx USING (mesh) WHERE regexp_matches(nm, 'left|^l_|_l$|riglarm|riglleg|_larm|_lleg|flleg|blleg|lfrontleg|lbackleg|llegfront|llegback') GROUP BY mesh),
pb AS (SELECT mesh, bone_idx, nm, greatest(0.0, least(1.0, (z - lz) / greatest(hz - lz, 1.0))) AS nz, (CASE WHEN ay THEN y ELSE x END - mid) / half AS la, coalesce(ls, -1) AS ls FROM pn JOIN bx USING (mesh) LEFT JOIN lf USING (mesh))"""


@query("e16_spatial_score", f"""WITH RECURSIVE {SQL_PLACED} SELECT mesh, bone_idx, round(greatest(0.0, least(0.28, CASE WHEN nz > 0.35 AND abs(la) > 0.55 THEN 0.20 ELSE 0.03 END + CASE WHEN sign(la) = sign(ls) THEN 0.08 ELSE -0.12 END)), 6)::DOUBLE AS left_hand,
 round(greatest(0.0, least(0.28, 0.20 * greatest(0.0, least(1.0, 1 - abs(nz - 0.42) / 0.32)) + CASE WHEN abs(la) < 0.20 THEN 0.05 ELSE 0.0 END)), 6)::DOUBLE AS pelvis FROM pb""")
def _(spark, sf):
    p = H.placed_bones(bones(spark, sf))
    args = (F.col("nz"), F.col("lateral"), F.col("left_sign"))
    return p.select("mesh", "bone_idx", r6(H.spatial_score("Hand", -1, *args)).alias("left_hand"), r6(H.spatial_score("Pelvis", 0, *args)).alias("pelvis"))


def _sql_name_score(tokens: list[str]) -> str:
    plain = [t.lower().translate(str.maketrans(".- ", "___")) for t in tokens]
    any_of = lambda test: " OR ".join(test(t) for t in plain)
    return (f"CASE WHEN nm IN ({', '.join(repr(t) for t in plain)}) THEN 0.70 WHEN {any_of(lambda t: f'ends_with(nm, {chr(39)}_{t}{chr(39)}) OR starts_with(nm, {chr(39)}{t}_{chr(39)})')} THEN 0.64 "
            f"WHEN {any_of(lambda t: f'contains(nm, {chr(39)}{t}{chr(39)})')} THEN 0.56 ELSE 0.0 END::DOUBLE")


_ZONE = {"Root": "CASE WHEN nz < 0.35 THEN 0.20 ELSE 0.02 END", "Pelvis": "0.20 * greatest(0.0, least(1.0, 1.0 - abs(nz - 0.42) / 0.32))",
         "CenterUpper": "CASE WHEN nz > 0.45 AND abs(la) < 0.30 THEN 0.20 ELSE 0.04 END", "Head": "CASE WHEN nz > 0.82 THEN 0.20 ELSE nz * 0.12 END",
         "Arm": "CASE WHEN nz > 0.45 AND abs(la) > 0.18 THEN 0.18 ELSE 0.03 END", "Hand": "CASE WHEN nz > 0.35 AND abs(la) > 0.55 THEN 0.20 ELSE 0.03 END",
         "Leg": "CASE WHEN nz < 0.55 AND abs(la) > 0.04 THEN 0.18 ELSE 0.03 END", "Foot": "CASE WHEN nz < 0.18 THEN 0.20 ELSE 0.02 END"}


def _sql_place_score(zone: str, side: int) -> str:
    bonus = f"CASE WHEN sign(la) = {'' if side < 0 else '-'}sign(ls) THEN 0.08 ELSE -0.12 END" if side else "CASE WHEN abs(la) < 0.20 THEN 0.05 ELSE 0.0 END"
    return f"round(greatest(0.0, least(0.28, ({_ZONE[zone]}) + {bonus}))::DOUBLE, 9)"


_AT = {s[0]: i + 1 for i, s in enumerate(C.ROLE_SPECS)}
_ROLES = len(C.ROLE_SPECS)
# step k looks for role k % 19: at first among bones of a fitting name, in the second round among all that are left
SQL_CHOOSE = f"""{SQL_PLACED}, {'cl AS' + SQL_CLOSURE.split(', cl AS', 1)[1]}, kd AS (SELECT mesh, ancestor AS bone_idx, count(*) AS kids FROM cl WHERE distance = 1 GROUP BY ALL),
se AS (SELECT pb.mesh, pb.bone_idx, bo.parent_idx, coalesce(kids, 0) AS kids, [{', '.join(_sql_name_score(s[1]) for s in C.ROLE_SPECS)}] AS ns, [{', '.join(_sql_place_score(s[3], s[4]) for s in C.ROLE_SPECS)}] AS ss
 FROM pb JOIN bo USING (mesh, bone_idx) LEFT JOIN kd USING (mesh, bone_idx)),
pk AS (SELECT DISTINCT mesh, 0 AS k, list_transform(range(0, {_ROLES}), lambda v: NULL::BIGINT) AS fb, list_transform(range(0, {_ROLES}), lambda v: 0.0::DOUBLE) AS fc, list_transform(range(0, {_ROLES}), lambda v: 0.0::DOUBLE) AS fn FROM se
 UNION ALL SELECT mesh, k + 1, CASE WHEN ok THEN list_concat(fb[1:r-1], [bone_idx], fb[r+1:]) ELSE fb END, CASE WHEN ok THEN list_concat(fc[1:r-1], [score], fc[r+1:]) ELSE fc END, CASE WHEN ok THEN list_concat(fn[1:r-1], [name], fn[r+1:]) ELSE fn END
 FROM (SELECT *, fb[r] IS NULL AND score >= 0.20 AND (({[bool(s[5]) for s in C.ROLE_SPECS]})[r] OR name > 0) AS ok FROM (SELECT *, CASE WHEN list_contains(fb, bone_idx) OR (k < {_ROLES} AND name <= 0) THEN 0.0 ELSE greatest(0.0, least(1.0, name + place + link)) END AS score FROM (
  SELECT f.mesh, f.k, f.fb, f.fc, f.fn, f.r, e.bone_idx, e.ns[f.r] AS name, e.ss[f.r] AS place,
   CASE WHEN f.r = {_AT['Root']} AND e.parent_idx IS NULL THEN 0.50 WHEN f.up IS NULL THEN 0.0 WHEN cl.distance IS NULL THEN -0.18 ELSE greatest(0.20, least(0.44, 0.44 - 0.05 * greatest(0, cl.distance - 1))) END
   + CASE WHEN f.r = {_AT['Pelvis']} AND e.kids >= 3 THEN 0.08 ELSE 0.0 END AS link
  FROM (SELECT *, fb[nullif(({[_AT.get(s[2], 0) for s in C.ROLE_SPECS]})[r], 0)] AS up FROM (SELECT *, k % {_ROLES} + 1 AS r FROM pk WHERE k < {2 * _ROLES})) f JOIN se e ON e.mesh = f.mesh LEFT JOIN cl ON cl.mesh = f.mesh AND cl.bone_idx = e.bone_idx AND cl.ancestor = f.up))
  QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY score DESC, bone_idx) = 1)),
pe AS (SELECT pk.mesh, fb, fc, fn, fb[{_AT['Root']}] IS NOT NULL AND fn[{_AT['Root']}] <= 0 AND bo.mesh IS NOT NULL AS swap FROM pk LEFT JOIN bo ON bo.mesh = pk.mesh AND bo.bone_idx = pk.fb[{_AT['Pelvis']}] AND bo.parent_idx IS NULL WHERE k = {2 * _ROLES}),
ch AS (SELECT mesh, ({C.ROLE_NAMES})[i] AS role, fb[s] AS bone_idx, fc[s] AS confidence, fn[s] AS name_score FROM (SELECT *, CASE WHEN i = {_AT['Root']} AND swap THEN {_AT['Pelvis']} ELSE i END AS s FROM pe, range(1, {_ROLES + 1}) t(i)))"""


@query("h3_infer_roles", f"WITH RECURSIVE {SQL_CHOOSE} SELECT mesh, role, bone_idx, round(confidence, 6) AS confidence, round(name_score, 6) AS name_score, name_score <= 0 AS forced FROM ch WHERE bone_idx IS NOT NULL")
def _(spark, sf):
    return H.infer_roles(bones(spark, sf)).withColumns({c: r6(F.col(c)) for c in ("confidence", "name_score")})


def stand_in_roles(spark, sf):
    """Every third bone holds the next role of the list."""
    p = table(spark, sf, "part")
    k, i = F.col("p_partkey"), F.col("p_partkey") % 64
    return p.where((i % 3 == 0) & (i / 3 < 19)).select(
        F.floor(k / 64).alias("mesh"), F.get(F.array(*[F.lit(r) for r in C.ROLE_NAMES]), F.floor(i / 3).cast("int")).alias("role"), i.alias("bone_idx"),
        (F.col("p_size") / 50.0 * 0.6 + 0.4).alias("confidence"), (k % 29 == 0).alias("manual"), F.when(k % 5 == 0, 0.0).otherwise(0.7).alias("name_score"))


SQL_ROLES = f"""ro AS (SELECT p_partkey // 64 AS mesh, ({C.ROLE_NAMES})[(p_partkey % 64) // 3 + 1] AS role, p_partkey % 64 AS bone_idx, p_size / 50.0 * 0.6 + 0.4 AS confidence, p_partkey % 29 = 0 AS manual, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 0.7 END AS name_score
 FROM part WHERE p_partkey % 64 % 3 = 0 AND p_partkey % 64 // 3 < 19)"""
SQL_PARENT = "(VALUES " + ", ".join(f"('{s[0]}', '{s[2]}')" for s in C.ROLE_SPECS if s[2]) + ") t(role, parent_role)"
SQL_TWIN = "(VALUES " + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in C.PAIRED_ROLES) + ") t(role, twin)"
SQL_DEMOTE = SQL_CLOSURE + f""", {SQL_ROLES}, de AS (SELECT mesh, bone_idx, max(distance) AS depth FROM cl GROUP BY ALL),
d1 AS (SELECT r.*, coalesce(de.depth, 0) AS depth, p.bone_idx IS NOT NULL AND cl.ancestor IS NULL AS astray FROM ro r LEFT JOIN {SQL_PARENT} USING (role) LEFT JOIN ro p ON p.mesh = r.mesh AND p.role = t.parent_role LEFT JOIN cl ON cl.mesh = r.mesh AND cl.bone_idx = r.bone_idx AND cl.ancestor = p.bone_idx LEFT JOIN de ON de.mesh = r.mesh AND de.bone_idx = r.bone_idx),
d2 AS (SELECT *, CASE WHEN astray AND NOT manual THEN least(confidence, 0.40) ELSE confidence END AS c1 FROM d1),
d3 AS (SELECT a.*, b.bone_idx IS NOT NULL AND least(a.c1, b.c1) < 0.90 AND a.depth <> b.depth AS uneven FROM d2 a LEFT JOIN {SQL_TWIN} USING (role) LEFT JOIN d2 b ON b.mesh = a.mesh AND b.role = t.twin),
dm AS (SELECT mesh, role, bone_idx, CASE WHEN uneven AND NOT manual THEN least(c1, 0.40) ELSE c1 END AS confidence, manual, name_score, astray AND NOT manual AS astray, uneven AND NOT manual AS uneven FROM d3)"""


@query("h4_role_consistency_demote", f"WITH RECURSIVE {SQL_DEMOTE} SELECT mesh, role, bone_idx, round(confidence, 6)::DOUBLE AS confidence, astray, uneven FROM dm")
def _(spark, sf):
    d = H.demote_roles(stand_in_roles(spark, sf), bones(spark, sf))
    return d.select("mesh", "role", "bone_idx", r6(F.col("confidence")).alias("confidence"), "astray", "uneven")


NEED = [s[0] for s in C.ROLE_SPECS if s[5]]
SQL_READY = f"""rd AS (SELECT m.mesh, coalesce(count(*) FILTER (WHERE role IN {tuple(NEED)} AND (manual OR name_score > 0) AND confidence >= 0.55), 0) / {len(NEED)} AS readiness, count(*) FILTER (WHERE NOT manual AND name_score <= 0) AS forced_roles FROM (SELECT DISTINCT mesh FROM bo) m LEFT JOIN dm USING (mesh) GROUP BY m.mesh)"""


@query("h5_readiness", f"WITH RECURSIVE {SQL_DEMOTE}, {SQL_READY} SELECT mesh, round(readiness, 6) AS readiness, forced_roles, CASE WHEN readiness >= 0.9 THEN 'A' WHEN readiness >= 0.7 THEN 'B' ELSE 'C' END AS tier FROM rd")
def _(spark, sf):
    bo = bones(spark, sf)
    r = H.readiness(H.demote_roles(stand_in_roles(spark, sf), bo), bo.select("mesh").distinct())
    return r.withColumn("readiness", r6(F.col("readiness")))


@query("a30_skeleton_audit", f"""WITH {SQL_BONES}, {SQL_ROLES}, rd AS (SELECT mesh, count(*) FILTER (WHERE role IN {tuple(NEED)} AND (manual OR name_score > 0) AND confidence >= 0.55) / {len(NEED)} AS readiness, count(*) AS mapped, count(*) FILTER (WHERE confidence < 0.6) AS low, count(*) FILTER (WHERE NOT manual AND name_score <= 0) AS forced FROM ro GROUP BY mesh),
nb AS (SELECT mesh, count(*) AS bones FROM bo GROUP BY mesh) SELECT mesh, bones, mapped AS mapped_roles, low AS low_confidence_roles, forced AS forced_roles, round(readiness, 6) AS readiness, CASE WHEN readiness >= 0.9 THEN 'A' WHEN readiness >= 0.7 THEN 'B' ELSE 'C' END AS tier FROM nb JOIN rd USING (mesh)""")
def _(spark, sf):
    bo, ro = bones(spark, sf), stand_in_roles(spark, sf)
    ready = H.readiness(ro, bo.select("mesh").distinct()).select("mesh", "readiness")
    return SC.skeleton_audit(ro.withColumn("forced", ~F.col("manual") & (F.col("name_score") <= 0)), bo, ready).withColumn("readiness", r6(F.col("readiness")))


@query("a30_tier_histogram", f"""WITH {SQL_BONES}, {SQL_ROLES}, rd AS (SELECT mesh, count(*) FILTER (WHERE role IN {tuple(NEED)} AND (manual OR name_score > 0) AND confidence >= 0.55) / {len(NEED)} AS readiness FROM ro GROUP BY mesh)
SELECT coalesce(tier, 'all') AS tier, count(*) AS meshes, round(avg(readiness), 6) AS readiness FROM (SELECT *, CASE WHEN readiness >= 0.9 THEN 'A' WHEN readiness >= 0.7 THEN 'B' ELSE 'C' END AS tier FROM rd) GROUP BY ROLLUP (tier)""")
def _(spark, sf):
    r = H.readiness(stand_in_roles(spark, sf), bones(spark, sf).select("mesh").distinct())
    return SC.tier_histogram(r).withColumn("readiness", r6(F.col("readiness")))


SQL_HANDS = "hd AS (SELECT * FROM (SELECT DISTINCT mesh FROM bo), (VALUES ('Left', 1), ('Right', 2)) t(side, hand_idx))"
SQL_FINGER = "CASE WHEN contains(lower(name), 'thumb') THEN 'Thumb' WHEN contains(lower(name), 'index') THEN 'Index' WHEN contains(lower(name), 'middle') THEN 'Middle' WHEN regexp_matches(lower(name), 'ring') THEN 'Ring' WHEN regexp_matches(lower(name), 'pinky|little') THEN 'Pinky' END"


@query("h6_finger_roles", f"""WITH RECURSIVE {SQL_CLOSURE}, {SQL_HANDS}, f AS (SELECT bo.mesh, hd.side, {SQL_FINGER} AS finger, bo.bone_idx, cl.distance FROM bo JOIN cl USING (mesh, bone_idx) JOIN hd ON hd.mesh = bo.mesh AND hd.hand_idx = cl.ancestor WHERE NOT regexp_matches(lower(name), 'metacarpal|carpus') AND cl.distance <= 16),
r AS (SELECT *, row_number() OVER (PARTITION BY mesh, side, finger ORDER BY distance, bone_idx) AS j FROM f WHERE finger IS NOT NULL) SELECT mesh, side || finger || j AS role, bone_idx FROM r WHERE j <= 3""")
def _(spark, sf):
    bo = bones(spark, sf)
    hands = bo.select("mesh").distinct().select("mesh", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).cast("bigint").alias("hand_idx")) for s, i in (("Left", 1), ("Right", 2))])))
    return H.finger_roles(bo, hands)


@query("h7_nearest_role_of_twist", f"""WITH RECURSIVE {SQL_CLOSURE}, {SQL_ROLES}, n AS (SELECT bo.mesh, bo.bone_idx, bo.name, ro.role, cl.distance FROM bo JOIN cl USING (mesh, bone_idx) JOIN ro ON ro.mesh = bo.mesh AND ro.bone_idx = cl.ancestor WHERE regexp_matches(lower(bo.name), 'twist|roll|torsion') QUALIFY row_number() OVER (PARTITION BY bo.mesh, bo.bone_idx ORDER BY cl.distance) = 1)
SELECT mesh, role, bone_idx, distance FROM n QUALIFY row_number() OVER (PARTITION BY mesh, role ORDER BY distance, name, bone_idx) = 1""")
def _(spark, sf):
    return H.twist_of_role(bones(spark, sf), stand_in_roles(spark, sf))


@query("h8_posture", f"""WITH {B.PO}, g AS (SELECT pair, sample, max(CASE WHEN role = 'LeftFoot' THEN z END) lf, max(CASE WHEN role = 'RightFoot' THEN z END) rf, max(CASE WHEN role = 'LeftHand' THEN z END) lh, max(CASE WHEN role = 'RightHand' THEN z END) rh, max(CASE WHEN role = 'Head' THEN z END) hd,
 max(CASE WHEN role = 'Neck' THEN z END) nz, max(CASE WHEN role = 'Neck' THEN x END) nx, max(CASE WHEN role = 'Neck' THEN y END) ny, max(CASE WHEN role = 'Pelvis' THEN x END) px, max(CASE WHEN role = 'Pelvis' THEN y END) py, max(CASE WHEN role = 'Pelvis' THEN z END) pz FROM po WHERE side = 's' GROUP BY ALL),
r AS (SELECT *, (lf + rf) / 2 AS foot, (lh + rh) / 2 AS hand, coalesce(hd, nz, 0.0) - (lf + rf) / 2 AS tall FROM g), v AS (SELECT *, CASE WHEN foot IS NOT NULL AND hand IS NOT NULL AND tall > 1e-4 THEN (hand - foot) / tall END AS ratio, sqrt((nx-px)**2 + (ny-py)**2 + (nz-pz)**2) AS len FROM r),
w AS (SELECT *, CASE WHEN ratio IS NOT NULL AND len > 1e-4 THEN abs(nz - pz) / len END AS up FROM v) SELECT pair * 1000 + sample AS body, round(ratio, 5) AS hand_above_foot, round(up, 6) AS spine_upright, CASE WHEN ratio IS NULL THEN true ELSE ratio >= 0.25 AND (up IS NULL OR up >= 0.5) END AS upright_biped FROM w""")
def _(spark, sf):
    rows = H.posture(B.poses(spark, sf).where("side = 's'"), ["pair", "sample"])
    return rows.select((F.col("pair") * 1000 + F.col("sample")).alias("body"), F.round("hand_above_foot", 5).alias("hand_above_foot"),
                       r6(F.col("spine_upright")).alias("spine_upright"), "upright_biped")


@query("h9_motion_bone", f"""WITH RECURSIVE {SQL_BONES}, w AS (SELECT mesh, bone_idx AS start_idx, bone_idx AS at_, 0 AS n FROM bo UNION ALL SELECT w.mesh, w.start_idx, b.parent_idx, w.n + 1 FROM w JOIN bo b ON b.mesh = w.mesh AND b.bone_idx = w.at_ JOIN bo u ON u.mesh = b.mesh AND u.bone_idx = b.parent_idx
 WHERE w.n < 8 AND b.x*b.x + b.y*b.y + b.z*b.z <= 1 AND u.parent_idx IS NOT NULL) SELECT mesh, start_idx, arg_max(at_, n) AS bone_idx FROM w GROUP BY ALL""")
def _(spark, sf):
    bo = bones(spark, sf)
    return H.motion_bone(bo, bo.select("mesh", F.col("bone_idx").alias("start_idx")))


SQL_ROOT = B.FR + f""", so AS (SELECT clip, frame, sig[1] x, sig[2] y, sig[3] z, sig[4] + 2 AS h FROM fr), nn AS (SELECT clip, count(*) AS n FROM fr GROUP BY clip HAVING count(*) >= 2),
ta AS (SELECT nn.clip, k, n, 0.02 * (k % 2) * CASE WHEN nn.clip % 3 = 0 THEN 5 ELSE 1 END AS x FROM nn, range(0, 12) r(k)),
ok AS (SELECT clip FROM ta GROUP BY clip HAVING max(x) - min(x) <= 0.05),
jn AS (SELECT ta.clip, k, s.x, s.y, s.z, (p.sig[57]) AS px, p.sig[58] AS py, p.sig[59] AS pz, {'{'}'qx': p.sig[61] / nq, 'qy': p.sig[62] / nq, 'qz': -p.sig[63] / nq{'}'} AS u, p.sig[61] / nq AS qx, p.sig[62] / nq AS qy, p.sig[63] / nq AS qz, p.sig[64] / nq AS qw, h.th / h.sh AS ratio
 FROM ta JOIN ok USING (clip) JOIN so s ON s.clip = ta.clip AND s.frame = floor(k * (n - 1) / 11 + 0.5) JOIN (SELECT *, sqrt(sig[61]**2 + sig[62]**2 + sig[63]**2 + sig[64]**2) AS nq FROM fr WHERE frame = 0) p ON p.clip = ta.clip JOIN (SELECT clip, sig[4] + 2 AS sh, sig[5] + 1 AS th FROM fr WHERE frame = 0) h ON h.clip = ta.clip),
wv AS (SELECT *, x * ratio - px AS wx, y * ratio - py AS wy, z * ratio - pz AS wz FROM jn)"""
_C = ["2*(-qy*wz + qz*wy)", "2*(-qz*wx + qx*wz)", "2*(-qx*wy + qy*wx)"]


@query("h11_bake_root_motion", f"""WITH {SQL_ROOT}, tv AS (SELECT *, {_C[0]} AS tx, {_C[1]} AS ty, {_C[2]} AS tz FROM wv)
SELECT clip, k::INT AS k, round(wx + qw*tx + (-qy)*tz - (-qz)*ty, 6) AS x, round(wy + qw*ty + (-qz)*tx - (-qx)*tz, 6) AS y, round(wz + qw*tz + (-qx)*ty - (-qy)*tx, 6) AS z FROM tv""")
def _(spark, sf):
    from framewise.operators import joins as J
    fr = B.frames(spark, sf)
    g = lambda i: F.get("sig", F.lit(i))
    src = J.nearest_key_resample(fr.select("clip", "frame", g(0).alias("x"), g(1).alias("y"), g(2).alias("z")), ["clip"], "frame", 12).withColumnRenamed("key", "k")
    first = fr.where("frame = 0").select("clip", g(56).alias("px"), g(57).alias("py"), g(58).alias("pz"), F.array(*V.unit4([g(60), g(61), g(62), g(63)])).alias("pq"))
    move = 0.02 * (F.col("k") % 2) * F.when(F.col("clip") % 3 == 0, 5).otherwise(1)
    tgt = src.select("clip", "k").join(first, "clip").withColumns({"x": move, "y": F.lit(0.0), "z": F.lit(0.0)})
    heights = fr.where("frame = 0").select("clip", (g(3) + 2).alias("source_height"), (g(4) + 1).alias("target_height"))
    return H.bake_root_motion(src, tgt, heights, "clip").select("clip", "k", *[r6(F.col(c)).alias(c) for c in "xyz"])


def _qp(a, b):
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [f"({aw}*{bx} + {ax}*{bw} + {ay}*{bz} - {az}*{by})", f"({aw}*{by} - {ax}*{bz} + {ay}*{bw} + {az}*{bx})",
            f"({aw}*{bz} + {ax}*{by} - {ay}*{bx} + {az}*{bw})", f"({aw}*{bw} - {ax}*{bx} - {ay}*{by} - {az}*{bz})"]


_D = _qp(["-a[1]", "-a[2]", "-a[3]", "a[4]"], [f"b[{i}]" for i in range(1, 5)])
_E = _qp([f"t[{i}]" for i in range(1, 5)], [f"d{i}" for i in range(1, 5)])
_U = "list_transform(sig[{0}:{1}], lambda v: v / sqrt(list_sum(list_transform(sig[{0}:{1}], lambda w: w*w))))"


@query("h12_bake_twist", f"""WITH {B.FR}, q AS (SELECT vec_id, {_U.format(1, 4)} AS a, {_U.format(5, 8)} AS b, {_U.format(9, 12)} AS t FROM fr), d AS (SELECT vec_id, t, {', '.join(f'{e} AS d{i + 1}' for i, e in enumerate(_D))} FROM q), e AS (SELECT vec_id, {', '.join(f'{e} AS e{i + 1}' for i, e in enumerate(_E))} FROM d)
SELECT vec_id, {', '.join(f'round(e{i} / sqrt(e1*e1 + e2*e2 + e3*e3 + e4*e4), 6) AS q{i}' for i in range(1, 5))} FROM e""")
def _(spark, sf):
    fr = B.frames(spark, sf)
    u = lambda at: F.array(*V.unit4([F.get("sig", F.lit(at + i)) for i in range(4)]))
    t = H.bake_twist(fr.select("vec_id", u(0).alias("sq0"), u(4).alias("sq"), u(8).alias("tq0")))
    return t.select("vec_id", *[r6(F.get("baked", F.lit(i))).alias(f"q{i + 1}") for i in range(4)])


@query("h13_appearance_descriptor_norm", f"""WITH {B.FR}, h AS (SELECT vec_id, list_transform(sig[1:54], lambda x: floor(abs(x) * 100)) AS c, list_transform(sig[55:64], lambda x: floor(abs(x) * 100)) AS v FROM fr),
d AS (SELECT vec_id, list_concat(list_transform(c, lambda x: x / greatest(1.0, list_sum(c))), list_transform(v, lambda x: x / greatest(1.0, list_sum(v)))) AS d FROM h) SELECT vec_id, round(list_sum(d), 6) AS mass, round(list_max(d), 6) AS peak, round(d[60], 6) AS bin60 FROM d""")
def _(spark, sf):
    h = B.frames(spark, sf).select("vec_id", F.transform("sig", lambda x: F.floor(F.abs(x) * 100).cast("double")).alias("h"))
    d = h.select("vec_id", F.concat(V.l1_normalised(F.slice("h", 1, 54)), V.l1_normalised(F.slice("h", 55, 10))).alias("d"))
    return d.select("vec_id", r6(V.total(F.col("d"))).alias("mass"), r6(F.array_max("d")).alias("peak"), r6(F.get("d", F.lit(59))).alias("bin60"))


CHAINS = [("Spine", 0, 15), ("LeftArm", 1, 31), ("RightArm", 2, 13), ("LeftLeg", 5, 40), ("RightLeg", 12, 12)]


@query("h14_equal_length_chains", f"""WITH RECURSIVE {SQL_CLOSURE}, ch AS (SELECT mesh, chain, CASE WHEN mesh % 4 = 0 AND chain = 'LeftArm' THEN 3 ELSE s END AS s, e FROM (SELECT DISTINCT mesh FROM bo), (VALUES {', '.join(repr(c) for c in CHAINS)}) t(chain, s, e)),
le AS (SELECT ch.mesh, chain, CASE WHEN s = e AND EXISTS (SELECT 1 FROM bo WHERE bo.mesh = ch.mesh AND bo.bone_idx = e) THEN 1 WHEN s = e THEN 1 WHEN cl.distance IS NOT NULL THEN cl.distance + 1 ELSE 0 END AS n FROM ch LEFT JOIN cl ON cl.mesh = ch.mesh AND cl.bone_idx = ch.e AND cl.ancestor = ch.s),
mx AS (SELECT max(mesh) + 1 AS m FROM bo) SELECT a.mesh AS source_mesh, b.mesh AS target_mesh, a.chain, a.n::BIGINT AS source_bones, b.n::BIGINT AS target_bones, a.n > 0 AND a.n = b.n AS one_to_one FROM le a, mx JOIN le b ON b.mesh = (a.mesh + 1) % mx.m AND b.chain = a.chain""")
def _(spark, sf):
    bo = bones(spark, sf)
    rows = F.array(*[F.struct(F.lit(c).alias("chain"), F.when((F.col("mesh") % 4 == 0) & F.lit(c == "LeftArm"), 3).otherwise(s).cast("bigint").alias("start_idx"), F.lit(e).cast("bigint").alias("end_idx")) for c, s, e in CHAINS])
    chains = bo.select("mesh").distinct().select("mesh", F.inline(rows))
    n = bo.agg(F.max("mesh") + 1).scalar()
    pairs = bo.select("mesh").distinct().select(F.col("mesh").alias("source_mesh"), ((F.col("mesh") + 1) % n).alias("target_mesh"))
    return H.equal_chains(H.chain_lengths(bo, chains), pairs)


MANUAL = {0: '{"Head": "B5"}', 1: '{"Head": "B5", "Neck": "B5", "Tail": "B1"}', 2: '{"Head": 7, "Spine": "nowhere", "Root": "B3"}', 3: "not json", 4: '{"LeftHand": "B9"}'}
SQL_MANUAL = f"""mo AS (SELECT mesh, x.role AS role, x.bone AS bone, x.p AS p FROM (SELECT DISTINCT mesh FROM bo) m JOIN (VALUES (0, 'Head', 5, NULL), (1, 'Head', 5, NULL), (1, 'Neck', 5, 'bone_taken'), (1, 'Tail', NULL, 'unknown_role'), (2, 'Head', NULL, 'not_text'), (2, 'Spine', NULL, 'unknown_bone'), (2, 'Root', 3, NULL), (3, NULL, NULL, 'json'), (4, 'LeftHand', 9, NULL)) x(m, role, bone, p) ON x.m = mesh % 5)"""


def overrides(spark, sf):
    bo = bones(spark, sf).withColumn("name", F.concat(F.lit("B"), "bone_idx"))
    docs = bo.select("mesh").distinct().select("mesh", F.get(F.array(*[F.lit(MANUAL[i]) for i in range(5)]), (F.col("mesh") % 5).cast("int")).alias("doc"))
    return H.role_overrides(stand_in_roles(spark, sf), docs, bo)


@query("s9_read_role_overrides", f"""WITH {SQL_BONES}, {SQL_ROLES}, {SQL_MANUAL}, g AS (SELECT mesh, role, bone FROM mo WHERE p IS NULL)
SELECT mesh, role, bone_idx, round(confidence, 6)::DOUBLE AS confidence, false AS manual FROM ro WHERE (mesh, role) NOT IN (SELECT (mesh, role) FROM g) AND (mesh, bone_idx) NOT IN (SELECT (mesh, bone) FROM g) UNION ALL SELECT mesh, role, bone, 1.0, true FROM g""")
def _(spark, sf):
    return overrides(spark, sf)[0].withColumn("confidence", r6(F.col("confidence")))


@query("s9_override_diagnostics", f"WITH {SQL_BONES}, {SQL_MANUAL} SELECT mesh, role, p AS problem FROM mo WHERE p IS NOT NULL")
def _(spark, sf):
    return overrides(spark, sf)[1]


OFFS = [(-0.25, 0.0), (0.25, 0.0), (0.0, -0.25), (0.0, 0.25)]


@query("e26_motion_shift_geometry", f"""WITH li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, 20.0 + l_quantity AS lens, greatest(50.0, l_extendedprice / 50) AS depth, radians((l_discount - 0.05) * 300) AS yaw, (l_tax - 0.04) * 1000 AS mv, 36.0 / (2 * (20.0 + l_quantity)) AS th, 36.0 / (16.0/9.0) / (2 * (20.0 + l_quantity)) AS tv FROM lineitem),
pt AS (SELECT li.*, i, depth - mv AS wx, ([-0.25, 0.25, 0.0, 0.0])[i + 1] * 2 * th * depth AS wy, -([0.0, 0.0, -0.25, 0.25])[i + 1] * 2 * tv * depth AS wz, 0.5 + ([-0.25, 0.25, 0.0, 0.0])[i + 1] AS sx, 0.5 + ([0.0, 0.0, -0.25, 0.25])[i + 1] AS sy FROM li, range(0, 4) r(i)),
pr AS (SELECT *, wx * cos(yaw) + wy * sin(yaw) AS d, -wx * sin(yaw) + wy * cos(yaw) AS a FROM pt), en AS (SELECT *, 0.5 + 0.5 * (a / d) / th AS ex, 0.5 - 0.5 * (wz / d) / tv AS ey FROM pr WHERE d > 1e-4)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, round(avg(ex - sx), 6) AS dx, round(avg(ey - sy), 6) AS dy, round(CASE WHEN count(*) >= 2 THEN abs(arg_min(ex, i) - min_by(ex, CASE WHEN i > mi THEN i END)) / 0.5 ELSE 1.0 END, 6) AS scale
FROM (SELECT *, min(i) OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS mi, count(*) OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS c FROM en) WHERE c = 4 GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    out = S.motion_shift(li, F.greatest(F.lit(50.0), F.col("l_extendedprice") / 50), F.lit(20.0) + F.col("l_quantity"), F.lit(16.0 / 9.0), F.lit(20.0) + F.col("l_quantity"),
                         ((F.col("l_tax") - 0.04) * 1000, F.lit(0.0), F.lit(0.0)), (F.lit(0.0), (F.col("l_discount") - 0.05) * 300, F.lit(0.0)))
    return out.where("valid = 4").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "scale")])
