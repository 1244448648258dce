"""Record matching: overlaps, nearest values, ranks, radius and rule joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import vectors as V
from framewise.operators import kernels as N


def rank_aligned_join(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, tie: str) -> DataFrame:
    """Pair rows of equal rank by ``x`` inside a shot, only where both sides have the same count."""
    keys = list(keys)

    def ranked(df: DataFrame, s: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.select(*keys, F.row_number().over(w.orderBy(x, tie)).alias("rank"), F.count(F.lit(1)).over(w).alias(f"n_{s}"),
                         F.col(x).alias(f"x_{s}"), F.col(tie).alias(f"id_{s}"))

    return ranked(a, "a").join(ranked(b, "b"), [*keys, "rank"]).where("n_a = n_b")


def ordinal_status_join(captures: DataFrame, references: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """i-th capture against the i-th reference with the status of the comparison.

    captures: readable, people; references: subject_role.
    """
    j = captures.join(references.withColumn("__ref", F.lit(True)), [*keys, ordinal], "left")
    status = (F.when(F.col("__ref").isNull() | (F.coalesce("subject_role", F.lit("")) == ""), "skipped")
              .when(~F.col("readable"), "error").when(F.col("people") == 0, "no_person").otherwise("ok"))
    return j.withColumn("status", status).withColumn(
        "score", F.when(F.col("status").isin("error", "no_person"), 0.0)).drop("__ref")


def nearest_subject(people: DataFrame, shots: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Main person of each shot: nearest to the projected subject, else nearest in x among the large ones."""
    keys = list(keys)
    top = people.groupBy(*keys).agg(F.max("strength").alias("__max"))
    j = people.join(shots, keys).join(top, keys)
    projected = F.col("px").isNotNull()
    gap = F.when(projected, F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)).otherwise(
        F.abs(F.col("x") - F.col("ref_x")))
    usable = projected | (F.col("strength") >= 0.5 * F.col("__max"))
    return j.where(usable).groupBy(*keys).agg(
        F.min(F.struct(gap.alias("distance"), (-F.col("strength")).alias("s"), F.col(tie).alias("id"))).alias("m")).select(
        *keys, F.col("m.id").alias(tie), F.col("m.distance").alias("distance"))


def drop_over_shoulder(people: DataFrame, keys: Sequence[str], side: str, frame_w: float) -> DataFrame:
    """Remove the close foreground person of an over-the-shoulder shot; keep all if none would be left."""
    keys = list(keys)
    heights = people.groupBy(*keys).agg(F.array_sort(F.collect_list("height")).alias("__h"))
    j = people.join(heights, keys)
    upper = F.get("__h", F.floor(F.size("__h") / 2).cast("int"))
    touches = F.when(F.col(side) == "left", F.col("left") <= 4).when(F.col(side) == "right", F.col("right") >= frame_w - 4)
    front = F.coalesce((F.size("__h") >= 2) & touches & (F.col("height") >= 1.5 * upper), F.lit(False))
    marked = j.withColumn("__front", front)
    left_over = marked.groupBy(*keys).agg(F.count_if(~F.col("__front")).alias("__rest"))
    return marked.join(left_over, keys).where("NOT __front OR __rest = 0").drop("__h", "__front", "__rest")


def prefix_match_join(sources: DataFrame, results: DataFrame, key: str, name: str, result_name: str, order: str) -> DataFrame:
    """First result whose name starts with the source name (case-sensitive), within the same mesh.

    Equal result names are reduced to their first row, and each gives its beginnings of the lengths that source names of its
    mesh have; these meet the whole source names in an equi-join, so only true matches become rows.
    """
    few = results.groupBy(key, result_name).agg(F.min(order).alias(order))
    wanted = sources.select(key, name).distinct()
    sizes = wanted.select(key, F.length(name).alias("__n")).distinct()
    heads = few.join(sizes, key).where(F.length(result_name) >= F.col("__n")).withColumn(name, F.expr(f"left(`{result_name}`, __n)"))
    j = wanted.join(heads, [key, name])
    return j.groupBy(key, name).agg(F.min_by(result_name, order).alias(result_name), F.min(order).alias(order))


def skeleton_partition(animations: DataFrame, meshes: DataFrame, target_skeleton: int) -> DataFrame:
    """How each animation reaches the target: direct, through a source mesh, or not at all."""
    source = meshes.groupBy("skeleton").agg(F.coalesce(F.min(F.when(F.col("preview"), F.col("mesh"))), F.min("mesh")).alias("source_mesh"))
    j = animations.join(source, "skeleton", "left")
    direct = F.coalesce(F.col("skeleton") == target_skeleton, F.lit(False))
    route = F.when(direct, "direct").when(F.col("source_mesh").isNull(), "skipped").otherwise("retarget")
    return j.withColumn("route", route).withColumn("source_mesh", F.when(F.col("route") == "retarget", F.col("source_mesh")))


def cache_join(current: DataFrame, previous: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Cached, changed, new and removed entries of an index."""
    p = previous.select(key, F.col(fingerprint).alias("__old"), F.col("has_plan").alias("__plan"))
    c = current.select(key, F.col(fingerprint).alias("__new"), F.lit(True).alias("__there"))
    # one pass over both sides
    state = (F.when(F.col("__there").isNull(), "removed").when(F.col("__old").isNull(), "new")
             .when((F.col("__old") == F.col("__new")) & F.col("__plan"), "cached").otherwise("changed"))
    return c.join(p, key, "full_outer").select(key, state.alias("state"))


def motion_relation(a: Column, b: str) -> Column:
    """Partial credit between a shot's motion and the requested one."""
    score = F.when(a == b, 1.0)
    for x, y, value in C.RELATED_MOTIONS:
        if b in (x, y):
            score = score.when(a == (y if b == x else x), value)
    return score.otherwise(0.0)


def request_similarity(request: dict) -> Column:
    """Weighted similarity of a shot row (size, angle, motion, people) to one request."""
    terms: list[tuple[float, Column]] = []
    if request.get("size"):
        at = C.SIZE_ORDER.index(request["size"])
        distance = F.coalesce(*[F.when(F.col("size") == s, F.lit(float(abs(i - at)))) for i, s in enumerate(C.SIZE_ORDER)], F.lit(4.0))
        terms.append((1.0, F.greatest(F.lit(0.0), 1.0 - distance / 2.0)))
    if request.get("angle"):
        near = []
        if request["angle"] in C.ANGLE_ORDER:
            at = C.ANGLE_ORDER.index(request["angle"])
            near = [a for i, a in enumerate(C.ANGLE_ORDER) if abs(i - at) == 1]
        terms.append((0.7, F.when(F.col("angle") == request["angle"], 1.0).when(F.col("angle").isin(near), 0.35).otherwise(0.0)))
    if request.get("motion"):
        terms.append((0.8, motion_relation(F.col("motion"), request["motion"])))
    if request.get("people"):
        n, want = F.col("people"), request["people"]
        if request.get("ots"):
            score = F.when(n >= 1, 1.0).otherwise(0.0)
        elif want >= 3:
            score = F.when(n >= 3, 1.0).when(n == 2, 0.4).otherwise(0.0)
        else:
            score = F.when(n == want, 1.0).when(n > want, 0.3).when(n >= 1, 0.2).otherwise(0.0)
        terms.append((0.8, score))
    if not terms:
        return F.lit(0.5)
    total = F.lit(0.0)
    weight = 0.0
    for w, s in terms:
        total, weight = total + w * s, weight + w
    return total / weight


def similarity_array(shots: DataFrame, requests: Sequence[dict]) -> DataFrame:
    """Similarity of every shot to every clause of a request, as one array per shot (no row is multiplied)."""
    return shots.withColumn("sims", F.array(*[request_similarity(r) for r in requests]))


def nearest_key_resample(series: DataFrame, keys: Sequence[str], ordinal: str, target_keys: int) -> DataFrame:
    """Target key k takes source key round(k (S - 1) / (N - 1))."""
    keys = list(keys)
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    k = n.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(target_keys - 1))))
    at = F.floor(F.col("key") * (F.col("__n") - 1) / (target_keys - 1) + 0.5)
    at = F.greatest(F.lit(0), F.least(F.col("__n") - 1, at)).cast("bigint")
    return k.withColumn(ordinal, at).drop("__n").join(series, [*keys, ordinal])


def curve_bracket(curves: DataFrame, wanted: DataFrame, keys: Sequence[str], ratio: str, values: Sequence[str]) -> DataFrame:
    """Value of each curve at one wanted ratio, interpolated between the neighbours on both sides."""
    keys = list(keys)
    j = curves.join(wanted, keys)
    point = F.struct(F.col(ratio).alias("r"), *values)
    low = F.max(F.when(F.col(ratio) <= F.col("at"), point))
    high = F.min(F.when(F.col(ratio) >= F.col("at"), point))
    b = j.groupBy(*keys).agg(low.alias("lo"), high.alias("hi"), F.first("at").alias("at"))
    t = F.when(F.col("hi.r") == F.col("lo.r"), 0.0).otherwise((F.col("at") - F.col("lo.r")) / (F.col("hi.r") - F.col("lo.r")))
    return b.select(*keys, *[(F.col(f"lo.{v}") + (F.col(f"hi.{v}") - F.col(f"lo.{v}")) * t).alias(v) for v in values])


def nearest_curve_point(curves: DataFrame, wanted: DataFrame, keys: Sequence[str], ratio: str, values: Sequence[str], order: str) -> DataFrame:
    keys = list(keys)
    j = curves.join(wanted, keys)
    best = F.min(F.struct(F.abs(F.col(ratio) - F.col("at")).alias("d"), F.col(order).alias("o"), *values))
    return j.groupBy(*keys).agg(best.alias("m")).select(*keys, *[F.col(f"m.{v}").alias(v) for v in values])


def best_mapping(points: DataFrame, keys: Sequence[str], mirror: dict[str, str], body: DataFrame) -> DataFrame:
    """Mean joint gap under the direct and the mirrored joint map, the smaller one counts.

    points: (keys, side, role, x, y), side 's' truth and 't' prediction; body: (keys, span).
    Returns per frame: error and error relative to the body span.
    """
    keys = list(keys)
    truth = points.where("side = 's'").select(*keys, "role", F.col("x").alias("tx"), F.col("y").alias("ty"))
    joint = points.where("side = 't'")
    maps = F.array(*[F.struct(F.lit("direct").alias("variant"), F.col("role").alias("to")),
                     F.struct(F.lit("mirrored").alias("variant"),
                              F.create_map(*[F.lit(v) for kv in mirror.items() for v in kv])[F.col("role")].alias("to"))])
    both = joint.where(F.col("role").isin(list(mirror))).select(*keys, "x", "y", F.inline(maps)).withColumnRenamed("to", "role")
    gap = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    per = both.join(truth, [*keys, "role"]).groupBy(*keys, "variant").agg(F.avg(gap).alias("e"))
    best = per.groupBy(*keys).agg(F.min("e").alias("error"))
    return best.join(body, keys, "left").withColumn("body_error", F.when(F.col("span") > 1e-6, F.col("error") / F.col("span"))).drop("span")


def foreground_role(subjects: DataFrame, shots: DataFrame, actors: DataFrame, key: str) -> DataFrame:
    """Person for the foreground of each shot: the role seen most often, else the nearest other actor.

    subjects: (key, ord, role, cast); shots: (key, anchor, ax); actors: (key, actor, x).
    """
    counts = subjects.where("cast").groupBy(key, "role").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    frequent = counts.join(shots, key).where(F.col("role") != F.col("anchor")).groupBy(key).agg(
        F.max(F.struct("n", (-F.col("o")).alias("o"), "role")).alias("m"))
    near = actors.join(shots, key).where(F.col("actor") != F.col("anchor")).groupBy(key).agg(
        F.min(F.struct(F.abs(F.col("x") - F.col("ax")).alias("d"), "actor")).alias("m"))
    j = shots.join(frequent.select(key, F.col("m.role").alias("__r")), key, "left").join(
        near.select(key, F.col("m.actor").alias("__a")), key, "left")
    return j.select(key, F.coalesce("__r", "__a").alias("foreground"), F.when(F.col("__r").isNotNull(), "frequent").when(
        F.col("__a").isNotNull(), "nearest").otherwise("none").alias("source"))


def grid_search_azimuth(shots: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Best camera azimuth around the anchor out of 61 candidates; the first angle wins ties.

    shots: distance, side, height, lens, body (anchor height in cm), focus (aimed height as a share of it), screen_x, screen_y (where the
    anchor is wanted), aspect, and arrays of the other people: ox, oy (ground position relative to the anchor), oh
    (height), osx (wanted screen x), oratio (wanted size ratio).  At each angle the camera turns until the anchor is at its place; a person in
    front of its focus, its head or its chest counts as hiding it.  The whole grid of a batch is evaluated as arrays, without multiplying rows.
    """
    inputs = ["distance", "side", "height", "lens", "body", "focus", "screen_x", "screen_y", "aspect", "ox", "oy", "oh", "osx", "oratio"]
    best = N.azimuth_search()(*[F.col(c) for c in inputs])
    return shots.withColumn("__b", best).select(*columns, "__b.angle", "__b.cost")


def masked_diff_region(frames: DataFrame, a: str, b: str, width: int, threshold: float, min_area: float = 0.01) -> DataFrame:
    """Region where two pictures of the same frame differ: share, box, centre and side.

    Pictures are pixel arrays in row order, so both sides of a pixel are in one row.
    """
    mask = F.zip_with(a, b, lambda p, q: F.abs(p - q) > threshold)
    f = frames.withColumn("__m", F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull()))
    n = F.size("__m")
    xs, ys = F.transform("__m", lambda i: i % width), F.transform("__m", lambda i: F.floor(i / width).cast("int"))
    area = n / F.size(a)
    shown = area >= min_area
    centre = V.total(F.transform(xs, lambda x: x.cast("double"))) / n / width
    rows = F.size(a) / width
    return f.withColumns({
        "area": area, "x0": F.when(shown, F.array_min(xs) / width), "x1": F.when(shown, F.array_max(xs) / width),
        "y0": F.when(shown, F.array_min(ys) / rows), "y1": F.when(shown, F.array_max(ys) / rows),
        "center_x": F.when(shown, centre), "side": F.when(shown, F.when(centre < 0.5, "left").otherwise("right"))}).drop("__m")


def expected_over_shoulder(subjects: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Side on which a hidden near person must show; empty when there is none.

    subjects: depth, head_x, head_y, mid_x, mid_y (null behind the camera).
    """
    keys = list(keys)
    inside = lambda x, y: F.coalesce(F.col(x).between(-0.02, 1.02) & F.col(y).between(-0.02, 1.02), F.lit(False))
    s = subjects.withColumn("__vis", inside("head_x", "head_y") | inside("mid_x", "mid_y"))
    nearest = s.groupBy(*keys).agg(F.min(F.when(F.col("__vis"), F.col("depth"))).alias("__near"))
    hidden = s.join(nearest, keys).where(
        ~F.col("__vis") & (F.col("depth") > 0) & (F.col("depth") < F.col("__near")) & F.col("head_x").between(-1.0, 2.0))
    side = hidden.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), "head_x")).alias("f"))
    every = subjects.select(*keys).distinct()
    return every.join(side, keys, "left").select(*keys, F.when(F.col("f.head_x") > 0.5, "right").when(
        F.col("f").isNotNull(), "left").otherwise("").alias("side"))


def within_radius(shots: DataFrame, actors: DataFrame, scene: str, shot_id: str, actor_id: str, radius: float,
                  occluder_radius: float) -> DataFrame:
    """Staged subjects and possible occluders around each shot's anchor.

    Both sides are put on a grid with the larger radius as cell size; an anchor
    looks into its own and the eight neighbouring cells, never at a whole scene.
    """
    cell = max(radius, occluder_radius)
    c = lambda v: F.floor(F.col(v) / cell)
    near = F.array(*[F.struct((c("ax") + i).alias("cx"), (c("ay") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = shots.select(scene, shot_id, "ax", "ay", F.inline(near))
    a = actors.select(scene, actor_id, "x", "y", "required", c("x").alias("cx"), c("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2)
    hits = s.join(a, [scene, "cx", "cy"]).where(F.col(actor_id) != F.col(shot_id)).withColumn("d", d).where(F.col("d") <= occluder_radius)
    found = hits.groupBy(scene, shot_id).agg(
        F.count(F.lit(1)).alias("occluders"), F.count_if(F.col("d") <= radius).alias("staged"),
        F.count_if(F.col("required") & (F.col("d") <= radius)).alias("__req"))
    wanted = actors.where("required").groupBy(scene).agg(F.count(F.lit(1)).alias("__want"))
    own = actors.where("required").select(scene, F.col(actor_id).alias(shot_id), F.lit(1).alias("__own"))
    j = shots.join(found, [scene, shot_id], "left").join(wanted, scene, "left").join(own, [scene, shot_id], "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return j.select(scene, shot_id, zero("occluders").alias("occluders"), zero("staged").alias("staged"),
                    (zero("__req") >= zero("__want") - zero("__own")).alias("all_staged"))
