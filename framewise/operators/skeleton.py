"""Skeleton hierarchies: poses, roles, audits and motion baking.

A mesh has at most a few hundred bones, so its hierarchy is one row of arrays
in bone order.  One shuffle by mesh replaces recursive joins over all bones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import text as T
from framewise.functions import vectors as V
from framewise.operators import kernels as N
from framewise.scale import bind

POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]


def mesh_rows(bones: DataFrame, fields: list[str]) -> DataFrame:
    """One row per mesh: struct array ``b`` sorted by bone_idx (0-based, dense)."""
    return bones.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("bone_idx", "parent_idx", *fields))).alias("b"))


def ancestors(bones: DataFrame, limit: int | None = None) -> DataFrame:
    """(mesh, bone_idx, path): ancestors of every bone, nearest first, at most ``limit`` of them if it is given."""
    m = mesh_rows(bones, []).withColumn("p", F.transform("b", lambda s: s["parent_idx"]))
    one = m.select("mesh", "p", F.explode(F.transform("b", lambda s: s["bone_idx"])).alias("bone_idx"))
    start = F.struct(F.col("bone_idx").cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("path"))

    def climb(s: Column, _i: Column) -> Column:
        up = F.get("p", s["at"].cast("int")).cast("bigint")
        return F.when(s["at"].isNull() | up.isNull(), F.struct(F.lit(None).cast("bigint").alias("at"), s["path"].alias("path"))).otherwise(
            F.struct(up.alias("at"), F.array_append(s["path"], up).alias("path")))

    steps = F.sequence(F.lit(1), F.size("p") if limit is None else F.least(F.lit(limit), F.size("p")))
    return one.select("mesh", "bone_idx", F.aggregate(steps, start, climb, lambda s: s["path"]).alias("path"))


def closure(bones: DataFrame, limit: int | None = None) -> DataFrame:
    """(mesh, bone_idx, ancestor, distance) for all ancestor pairs."""
    return ancestors(bones, limit).select("mesh", "bone_idx", F.posexplode("path").alias("d", "ancestor")).select(
        "mesh", "bone_idx", "ancestor", (F.col("d") + 1).cast("bigint").alias("distance"))


def hierarchy_stats(bones: DataFrame) -> DataFrame:
    """Depth, number of descendants and number of direct children of every bone."""
    a = ancestors(bones)
    below = a.select("mesh", F.posexplode("path").alias("d", "bone_idx")).groupBy("mesh", "bone_idx").agg(
        F.count(F.lit(1)).alias("descendants"), F.count_if(F.col("d") == 0).alias("children"))
    return a.select("mesh", "bone_idx", F.size("path").alias("depth")).join(below, ["mesh", "bone_idx"], "left").fillna(
        0, ["descendants", "children"])


def component_pose(bones: DataFrame) -> DataFrame:
    """Component-space pose: child = local * parent, composed from the root down.

    A parallel prefix product along the parent pointers: each step joins every bone's transform with that of the bone it points at and
    doubles the pointer, so log2(bones) steps reach every root, whatever the depth.  Bones whose pointers never end are refused.
    """
    def doubled(state: Column, _: Column) -> Column:
        up = F.transform(state, lambda s: F.get(state, s["up"]))
        return F.zip_with(state, up, lambda s, u: F.when(u.isNull(), s).otherwise(F.struct(
            u["up"].alias("up"), *[c.alias(n) for n, c in zip(POSE, V.pose_product([u[n] for n in POSE], [s[n] for n in POSE]))])))

    m = mesh_rows(bones, POSE)
    local = F.transform("b", lambda s: F.struct(s["parent_idx"].cast("int").alias("up"), *[s[n].cast("double").alias(n) for n in POSE]))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size("b"), F.lit(1)))).cast("int"))
    j = bind(m, c=F.aggregate(steps, local, doubled))
    loop = F.exists("c", lambda s: s["up"].isNotNull())
    j = j.withColumn("c", F.when(loop, F.raise_error(F.lit("the bones of a mesh form a loop")).cast(j.schema["c"].dataType)).otherwise(F.col("c")))
    return j.select("mesh", F.inline(F.zip_with("b", "c", lambda s, p: F.struct(s["bone_idx"].alias("bone_idx"), *[p[n].alias(n) for n in POSE]))))


def mesh_bounds(pose: DataFrame) -> DataFrame:
    """Bounds of each mesh, its lateral axis and on which side the left-named bones are."""
    b = pose.groupBy("mesh").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))],
                                 F.collect_list(F.when(T.aux_bone_class(F.col("name"))["is_left"], F.struct("x", "y"))).alias("left"))
    size = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    axis_y = size("y") >= size("x")
    mid = lambda c: (F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2
    total = V.total(F.transform("left", lambda p: F.when(axis_y, p["y"] - mid("y")).otherwise(p["x"] - mid("x"))))
    return b.select("mesh", "lo_z", "hi_z", axis_y.alias("axis_y"), F.when(axis_y, mid("y")).otherwise(mid("x")).alias("mid"),
                    F.greatest(F.when(axis_y, size("y")).otherwise(size("x")) * 0.5, F.lit(1.0)).alias("half"),
                    F.when((F.size("left") > 0) & (total >= 0), 1.0).otherwise(-1.0).alias("left_sign"))


def spatial_score(zone: str, side: int, nz: Column, lateral: Column, left_sign: Column) -> Column:
    """Plausibility of a bone's place for a role, 0 .. 0.28."""
    a = F.abs(lateral)
    base = {
        "Root": F.when(nz < 0.35, 0.20).otherwise(0.02),
        "Pelvis": 0.20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(nz - 0.42) / 0.32)),
        "CenterUpper": F.when((nz > 0.45) & (a < 0.30), 0.20).otherwise(0.04),
        "Head": F.when(nz > 0.82, 0.20).otherwise(nz * 0.12),
        "Arm": F.when((nz > 0.45) & (a > 0.18), 0.18).otherwise(0.03),
        "Hand": F.when((nz > 0.35) & (a > 0.55), 0.20).otherwise(0.03),
        "Leg": F.when((nz < 0.55) & (a > 0.04), 0.18).otherwise(0.03),
        "Foot": F.when(nz < 0.18, 0.20).otherwise(0.02),
    }[zone]
    if side:
        expected = left_sign if side < 0 else -left_sign
        bonus = F.when(F.signum(lateral) == F.signum(expected), 0.08).otherwise(-0.12)
    else:
        bonus = F.when(a < 0.20, 0.05).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.28), base + bonus))


def placed_bones(bones: DataFrame) -> DataFrame:
    """Bones with component position, normalised height and lateral place in their mesh."""
    pose = component_pose(bones).select("mesh", "bone_idx", "x", "y", "z").join(
        bones.select("mesh", "bone_idx", "parent_idx", "name"), ["mesh", "bone_idx"])
    j = pose.join(mesh_bounds(pose), "mesh")
    nz = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") - F.col("lo_z")) / F.greatest(F.col("hi_z") - F.col("lo_z"), F.lit(1.0))))
    lateral = (F.when(F.col("axis_y"), F.col("y")).otherwise(F.col("x")) - F.col("mid")) / F.col("half")
    return bind(j, nz=nz, lateral=lateral)


def infer_roles(bones: DataFrame, specs=C.ROLE_SPECS) -> DataFrame:
    """Roles of each mesh: (mesh, role, bone_idx, confidence, name_score, forced).

    Name and place scores are columns; only the greedy choice, where one bone
    serves one role, runs per mesh.  Place scores are rounded, so that bones in
    like places tie and the first of them is chosen.
    """
    p = bind(placed_bones(bones), __n=T.normal_name(F.col("name")))
    scored = p.select("mesh", "bone_idx", "parent_idx", F.array(*[T.bone_name_score(F.col("__n"), s[1], True) for s in specs]).alias("ns"),
                      F.array(*[F.round(spatial_score(s[3], s[4], F.col("nz"), F.col("lateral"), F.col("left_sign")), 9) for s in specs]).alias("ss"))
    m = scored.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("bone_idx", "parent_idx", "ns", "ss"))).alias("b"))
    pick = N.pick_roles([s[0] for s in specs], [s[2] for s in specs], [s[5] for s in specs])(
        F.transform("b", lambda s: F.coalesce(s["parent_idx"], F.lit(-1)).cast("bigint")), F.flatten(F.transform("b", lambda s: s["ns"])),
        F.flatten(F.transform("b", lambda s: s["ss"])))
    return m.withColumn("r", pick).select("mesh", F.inline(F.arrays_zip(
        F.array(*[F.lit(s[0]) for s in specs]).alias("role"), F.col("r.bone").alias("bone_idx"), F.col("r.confidence").alias("confidence"),
        F.col("r.name_score").alias("name_score")))).where("bone_idx >= 0").withColumn("forced", F.col("name_score") <= 0)


def demote_roles(roles: DataFrame, bones: DataFrame, specs=C.ROLE_SPECS) -> DataFrame:
    """Cap the confidence at 0.40 where the hierarchy contradicts a role.

    A child role must hang under its parent role; left and right must be equally
    deep unless both are sure.  Manual roles are exempt.
    """
    up = ancestors(bones)
    r = roles.join(up, ["mesh", "bone_idx"])
    parent = F.create_map(*[F.lit(x) for s in specs if s[2] for x in (s[0], s[2])])
    holders = roles.select("mesh", F.col("role").alias("parent_role"), F.col("bone_idx").alias("parent_bone"))
    a = r.withColumn("parent_role", parent[F.col("role")]).join(holders, ["mesh", "parent_role"], "left")
    astray = F.coalesce(F.col("parent_bone").isNotNull() & ~F.array_contains("path", F.col("parent_bone")), F.lit(False))
    first = F.when(astray & ~F.col("manual"), F.least("confidence", F.lit(0.40))).otherwise(F.col("confidence"))
    a = a.withColumns({"__c": first, "__depth": F.size("path"), "__astray": astray})
    twin = F.create_map(*[F.lit(x) for l, q in C.PAIRED_ROLES for x in (l, q, q, l)])
    other = a.select("mesh", F.col("role").alias("twin"), F.col("__c").alias("tc"), F.col("__depth").alias("td"))
    b = a.withColumn("twin", twin[F.col("role")]).join(other, ["mesh", "twin"], "left")
    uneven = F.coalesce(F.col("td").isNotNull() & (F.least("__c", "tc") < 0.90) & (F.col("__depth") != F.col("td")), F.lit(False))
    out = F.when(uneven & ~F.col("manual"), F.least("__c", F.lit(0.40))).otherwise(F.col("__c"))
    return b.select("mesh", "role", "bone_idx", out.alias("confidence"), "manual", "name_score",
                    (F.col("__astray") & ~F.col("manual")).alias("astray"), (uneven & ~F.col("manual")).alias("uneven"))


def readiness(roles: DataFrame, meshes: DataFrame, specs=C.ROLE_SPECS) -> DataFrame:
    """Share of required roles that are sure and not a nameless guess."""
    need = [s[0] for s in specs if s[5]]
    forced = ~F.col("manual") & (F.col("name_score") <= 0)
    good = F.col("role").isin(need) & ~forced & (F.col("confidence") >= 0.55)
    g = roles.groupBy("mesh").agg((F.count_if(good) / len(need)).alias("readiness"), F.count_if(forced).alias("forced_roles"))
    j = meshes.join(g, "mesh", "left").fillna(0, ["readiness", "forced_roles"])
    return j.withColumn("tier", F.when(F.col("readiness") >= 0.90, "A").when(F.col("readiness") >= 0.70, "B").otherwise("C"))


def finger_roles(bones: DataFrame, hands: DataFrame, joints: int = 3, tie: str = "bone_idx") -> DataFrame:
    """Finger joints under each hand, numbered by depth; metacarpals do not count.

    hands: (mesh, side, hand_idx).
    """
    low = F.lower("name")
    finger = (F.when(low.contains("thumb"), "Thumb").when(low.contains("index"), "Index").when(low.contains("middle"), "Middle")
              .when(low.contains("ring"), "Ring").when(low.rlike("pinky|little"), "Pinky"))
    f = bones.where(~low.rlike("metacarpal|carpus")).select("mesh", "bone_idx", "name", finger.alias("finger")).where("finger IS NOT NULL")
    c = closure(bones, 16).join(hands.withColumnRenamed("hand_idx", "ancestor"), ["mesh", "ancestor"])
    j = f.join(c, ["mesh", "bone_idx"])
    w = Window.partitionBy("mesh", "side", "finger").orderBy("distance", tie)
    j = j.withColumn("joint", F.row_number().over(w)).where(F.col("joint") <= joints)
    return j.select("mesh", F.concat("side", "finger", F.col("joint")).alias("role"), "bone_idx")


def twist_of_role(bones: DataFrame, roles: DataFrame) -> DataFrame:
    """Closest twist bone of each role: nearest role-holding ancestor, then distance, then name."""
    twist = bones.where(F.lower("name").rlike("|".join(C.TWIST_TOKENS))).select("mesh", "bone_idx", "name")
    c = closure(bones, 16).join(roles.select("mesh", F.col("bone_idx").alias("ancestor"), "role"), ["mesh", "ancestor"])
    j = twist.join(c, ["mesh", "bone_idx"])
    near = j.groupBy("mesh", "bone_idx").agg(F.min(F.struct("distance", "role", "name")).alias("n"))
    return near.groupBy("mesh", F.col("n.role").alias("role")).agg(F.min(F.struct("n.distance", "n.name", "bone_idx")).alias("m")).select(
        "mesh", "role", F.col("m.bone_idx").alias("bone_idx"), F.col("m.distance").alias("distance"))


def posture(joints: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Upright or not, from the height of the hands and the direction of the spine; one row per body.

    joints: (keys, role, x, y, z), a body is all ``keys`` together; of a role that comes twice the largest position counts.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = ["LeftFoot", "RightFoot", "LeftHand", "RightHand", "Head", "Pelvis", "Neck"]
    g = joints.where(F.col("role").isin(names)).groupBy(*keys).agg(
        F.struct(*[F.max(F.when(F.col("role") == r, F.struct("x", "y", "z"))).alias(r) for r in names]).alias("m"))
    z = lambda r: F.col("m")[r]["z"]
    foot, hand = (z("LeftFoot") + z("RightFoot")) / 2, (z("LeftHand") + z("RightHand")) / 2
    tall = F.coalesce(z("Head"), z("Neck"), F.lit(0.0)) - foot
    g = g.withColumns({"foot": foot, "hand": hand, "tall": tall})
    judged = F.col("foot").isNotNull() & F.col("hand").isNotNull() & (F.col("tall") > 1e-4)
    ratio = F.when(judged, (F.col("hand") - F.col("foot")) / F.col("tall"))
    d = [F.col("m")["Neck"][c] - F.col("m")["Pelvis"][c] for c in "xyz"]
    length = V.norm3(d)
    upright = F.when(judged & (length > 1e-4), F.abs(d[2]) / length)
    return g.select(*keys, ratio.alias("hand_above_foot"), upright.alias("spine_upright")).withColumn(
        "upright_biped", F.when(F.col("hand_above_foot").isNull(), True).otherwise(
            (F.col("hand_above_foot") >= 0.25) & (F.col("spine_upright").isNull() | (F.col("spine_upright") >= 0.5))))


def motion_bone(bones: DataFrame, starts: DataFrame) -> DataFrame:
    """Bone that carries the offset: climb from the start while the local move is under 1 cm.

    starts: (mesh, start_idx).  Never climbs onto the root or past eight bones.
    """
    m = mesh_rows(bones, ["x", "y", "z"])
    j = starts.join(m, "mesh").withColumn("at", F.col("start_idx").cast("int"))

    def step(at: Column, _i: Column) -> Column:
        b = F.get("b", at)
        up = b["parent_idx"].cast("int")
        carries = b["x"] ** 2 + b["y"] ** 2 + b["z"] ** 2 > 1.0
        stop = carries | up.isNull() | F.get("b", up)["parent_idx"].isNull()
        return F.when(stop, at).otherwise(up)

    return j.select("mesh", "start_idx", F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("at"), step).cast("bigint").alias("bone_idx"))


def chain_lengths(bones: DataFrame, chains: DataFrame) -> DataFrame:
    """Bones from the end up to the start of each chain, 0 where the hierarchy does not connect them."""
    up = ancestors(bones).withColumnRenamed("bone_idx", "end_idx")
    j = chains.join(up, ["mesh", "end_idx"], "left")
    at = F.array_position("path", F.col("start_idx"))
    n = F.when(F.col("start_idx") == F.col("end_idx"), 1).when(at > 0, at + 1).otherwise(0)
    return j.select("mesh", "chain", F.coalesce(n, F.lit(0)).cast("bigint").alias("bones"))


def equal_chains(lengths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chains that can be matched bone by bone: same non-zero count on both sides of a mesh pair."""
    s = lengths.select(F.col("mesh").alias("source_mesh"), "chain", F.col("bones").alias("source_bones"))
    t = lengths.select(F.col("mesh").alias("target_mesh"), "chain", F.col("bones").alias("target_bones"))
    j = pairs.join(s, "source_mesh").join(t, ["target_mesh", "chain"])
    return j.select("source_mesh", "target_mesh", "chain", "source_bones", "target_bones",
                    ((F.col("source_bones") > 0) & (F.col("source_bones") == F.col("target_bones"))).alias("one_to_one"))


def bake_root_motion(source: DataFrame, target: DataFrame, heights: DataFrame, key: str) -> DataFrame:
    """Root positions for targets whose track does not move: source position times the height ratio, in parent space.

    source: (key, k, x, y, z) already resampled to the target's keys; target: (key, k, x, y, z,
    parent position px.. and rotation pq); heights: (key, source_height, target_height).
    """
    still = target.groupBy(key).agg(*[(F.max(c) - F.min(c)).alias(f"r{c}") for c in "xyz"], F.count(F.lit(1)).alias("n")).where(
        (F.greatest("rx", "ry", "rz") <= 0.05) & (F.col("n") >= 2)).select(key)
    s = source.select(key, "k", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    j = target.join(still, key, "left_semi").join(s, [key, "k"]).join(heights.where(F.abs("source_height") > 1e-4), key)
    ratio = F.col("target_height") / F.col("source_height")
    wanted = tuple(F.col(f"s{c}") * ratio - F.col(f"p{c}") for c in "xyz")
    q = tuple(F.get("pq", F.lit(i)) for i in range(4))
    local = V.rotate(V.conjugate(q), wanted)
    return j.select(key, "k", *[v.alias(c) for v, c in zip(local, "xyz")])


def bake_twist(tracks: DataFrame) -> DataFrame:
    """Twist keys: target rest * (source rest inverse * source key), normalised.  Columns sq0, sq, tq0 are quaternions."""
    q = lambda c: tuple(F.get(c, F.lit(i)) for i in range(4))
    delta = V.quaternion_product(V.conjugate(q("sq0")), q("sq"))
    out = V.unit4(V.quaternion_product(q("tq0"), delta))
    return tracks.withColumn("baked", F.array(*out))


def role_overrides(roles: DataFrame, overrides: DataFrame, bones: DataFrame, known: list[str] = C.ROLE_NAMES) -> tuple[DataFrame, DataFrame]:
    """Apply manual role -> bone maps. overrides: (mesh, doc). Returns new roles and diagnostics."""
    v = overrides.withColumn("v", F.try_parse_json("doc"))
    m = v.withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
    broken = m.where(F.col("m").isNull()).select("mesh", F.lit(None).cast("string").alias("role"), F.lit("json").alias("problem"))
    pairs = m.where(F.col("m").isNotNull()).select("mesh", F.explode("m").alias("role", "value"))
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    named = pairs.withColumn("name", text).join(bones.select("mesh", "name", "bone_idx"), ["mesh", "name"], "left")
    first = F.when(~F.col("role").isin(known), "unknown_role").when(F.col("name").isNull(), "not_text").when(F.col("bone_idx").isNull(), "unknown_bone")
    checked = named.withColumn("problem", first)
    w = Window.partitionBy("mesh", "bone_idx").orderBy("role")
    twice = checked.where("problem IS NULL").withColumn("problem", F.when(F.row_number().over(w) > 1, "bone_taken"))
    good = twice.where("problem IS NULL").select("mesh", "role", "bone_idx")
    notes = broken.unionByName(checked.where("problem IS NOT NULL").select("mesh", "role", "problem")).unionByName(
        twice.where("problem IS NOT NULL").select("mesh", "role", "problem"))
    keep = roles.join(good.select("mesh", "role"), ["mesh", "role"], "left_anti").join(good.select("mesh", "bone_idx"), ["mesh", "bone_idx"], "left_anti")
    new = good.select("mesh", "role", "bone_idx", F.lit(1.0).alias("confidence"), F.lit(True).alias("manual"))
    return keep.select("mesh", "role", "bone_idx", "confidence", F.lit(False).alias("manual")).unionByName(new), notes
