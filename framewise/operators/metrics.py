"""Motion and detection metrics.

Pose metrics work on pairs of clips of any length.  One shuffle brings both sides of a sample together instead of a
join per role; after it, only a sample's joints stand in one row.  What a pair is judged by merges: minima, counts and
first values are partial aggregates, medians go through :func:`framewise.scale.quantiles`, and steps between
neighbouring samples through :func:`framewise.scale.previous`.  The samples of a pair never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise import constants as C
from framewise import scale
from framewise.functions import vectors as V
from framewise.staging import stage


def sorted_median(a: Column) -> Column:
    """Median of an ascending array; null when empty."""
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def sorted_quantile(a: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array; null when empty."""
    at = (F.size(a) - 1) * p
    low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
    return F.when(F.size(a) > 0, low + (high - low) * (at - F.floor(at)))


def median_and_mad(values: Column) -> tuple[Column, Column]:
    a = F.array_sort(values)
    med = sorted_median(a)
    return med, sorted_median(F.array_sort(F.transform(a, lambda x: F.abs(x - med))))


def robust_stats(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Median, p90, MAD, spread (1.4826 MAD) and largest deviation; two passes, each exact."""
    keys = list(keys)
    first = scale.quantiles(df, keys, {"median": (column, 0.5), "p90": (column, 0.9)})
    away = F.abs(F.col(column) - F.col("median"))
    marked = df.join(first.select(*keys, "median"), keys).withColumn("__d", away)
    second = scale.quantiles(marked, keys, {"mad": ("__d", 0.5)})
    largest = marked.groupBy(*keys).agg(F.max("__d").alias("max_deviation"), F.count(column).alias("n"))
    return first.join(second, keys).join(largest, keys).withColumn("spread", F.col("mad") * 1.4826)


def estimate_fusion(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fuse log-height estimates (columns kind, log_h, weight) of one detection.

    Width estimates far below the vertical one are dropped, then everything
    further than 0.3 from the median; weights are inverse variances.
    """
    keys = list(keys)
    vertical = F.max(F.when(F.col("kind") == "vertical", F.col("log_h")))
    g = estimates.groupBy(*keys).agg(vertical.alias("v"), F.collect_list(F.struct("kind", "log_h", "weight")).alias("all"))
    usable = F.filter("all", lambda e: (e["kind"] == "vertical") | F.col("v").isNull() | (e["log_h"] >= F.col("v") - 0.35))
    g = g.withColumn("use", usable).where(F.size("use") > 0)
    g = g.withColumn("c", sorted_median(F.array_sort(F.transform("use", lambda e: e["log_h"]))))
    near = F.filter("use", lambda e: F.abs(e["log_h"] - F.col("c")) <= 0.3)
    kept = F.when(F.size(near) > 0, near).otherwise(F.col("use"))
    g = g.withColumn("kept", kept)
    weight = V.total(F.transform("kept", lambda e: e["weight"]))
    mean = V.total(F.transform("kept", lambda e: e["weight"] * e["log_h"])) / weight
    return g.select(*keys, F.exp(mean).alias("height"), F.size("kept").alias("n_kept"))


def line_fit(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One pass of the weighted fit y = ay + by * ratio, x = ax + bx * ratio (weights: scores)."""
    w, r = F.col("score"), F.col("ratio")
    sums = points.groupBy(*keys).agg(
        F.sum(w).alias("sw"), F.sum(w * r).alias("sr"), F.sum(w * r * r).alias("srr"),
        *[F.sum(w * F.col(c)).alias(f"s{c}") for c in "xy"], *[F.sum(w * r * F.col(c)).alias(f"sr{c}") for c in "xy"],
        (F.max(r) - F.min(r)).alias("span"), F.count(F.lit(1)).alias("n"))
    det = F.col("sw") * F.col("srr") - F.col("sr") * F.col("sr")
    fit = {f"b{c}": (F.col("sw") * F.col(f"sr{c}") - F.col("sr") * F.col(f"s{c}")) / det for c in "xy"}
    out = sums.where((F.col("n") >= 2) & (F.col("span") >= 0.1)).withColumns(fit)
    out = out.withColumns({f"a{c}": (F.col(f"s{c}") - F.col(f"b{c}") * F.col("sr")) / F.col("sw") for c in "xy"})
    return out.select(*keys, "ax", "bx", "ay", "by", "span", "n")


def calibrate_ratios(people: DataFrame, key: str, usable: Column, frame_h: float, min_samples: int = 3) -> DataFrame:
    """Body proportions of one video from detections that show hips and ankles: (key, name, ratio, n)."""
    ids = [*C.UPPER_KEYPOINTS, 11, 12, 15, 16]
    marked = people.select(key, "kp", usable.alias("__u"))
    # one-row generators: later filters are not pushed below them and do not repeat the expressions
    p = marked.select(key, F.inline(F.array(F.struct(*[
        F.when(F.array_contains("__u", i), F.get("kp", F.lit(i))).alias(f"p{i}") for i in ids]))))
    middle = lambda i, j, a: F.coalesce((F.col(f"p{i}.{a}") + F.col(f"p{j}.{a}")) / 2, F.col(f"p{i}.{a}"), F.col(f"p{j}.{a}"))
    p = p.select(*p.columns, F.inline(F.array(F.struct(*[
        middle(i, j, a).alias(f"{name}_{a}") for name, i, j in (("hip", 11, 12), ("foot", 15, 16)) for a in "xy"]))))
    drop = F.col("foot_y") - F.col("hip_y")
    p = p.where((drop >= 30.0) & (F.abs(F.col("foot_x") - F.col("hip_x")) <= 0.35 * drop))
    base = C.KEYPOINT_RATIO
    p = p.withColumn("unit", drop / (base[11] - base[15]))
    gap = lambda i, j: F.sqrt((F.col(f"p{i}.x") - F.col(f"p{j}.x")) ** 2 + (F.col(f"p{i}.y") - F.col(f"p{j}.y")) ** 2) / F.col("unit")
    rows = [F.struct(F.lit(str(i)).alias("name"), (base[11] + (F.col("hip_y") - F.col(f"p{i}.y")) / F.col("unit")).alias("value"))
            for i in C.UPPER_KEYPOINTS]
    rows += [F.struct(F.lit(n).alias("name"), F.when(F.col("unit") >= 0.5 * frame_h, gap(i, j)).alias("value"))
             for n, i, j in (("shoulder_width", 5, 6), ("ear_width", 3, 4))]
    implied = p.select(key, F.inline(F.array(*rows))).where("value IS NOT NULL")
    counts = implied.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)
    med = scale.quantiles(implied, [key, "name"], {"m": ("value", 0.5)}).join(counts, [key, "name"])
    default = F.create_map(*[F.lit(x) for i in C.UPPER_KEYPOINTS for x in (str(i), base[i])],
                           *[F.lit(x) for kv in C.WIDTH_RATIO.items() for x in kv])[F.col("name")]
    wide = F.col("name").isin(list(C.WIDTH_RATIO))
    low = F.when(wide, default * C.WIDTH_CLAMP[0]).otherwise(default - 0.06)
    high = F.when(wide, default * C.WIDTH_CLAMP[1]).otherwise(default + 0.06)
    return med.select(key, "name", F.greatest(low, F.least(high, F.col("m"))).alias("ratio"), "n")


def _samples(poses: DataFrame) -> DataFrame:
    """Both sides of each sample in one row: maps role -> {x, y, z}."""
    def side(s: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct(
            "role", F.struct("x", "y", "z").alias("p")))))
    return poses.groupBy("pair", "sample").agg(side("s").alias("s"), side("t").alias("t"))


def segment_angles(poses: DataFrame, segments: Sequence[tuple[str, str]]) -> DataFrame:
    """Angle between source and target direction of each body segment and sample."""
    names = F.array(*[F.struct(F.lit(f"{a}->{b}").alias("segment"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for a, b in segments])
    long = _samples(poses).select("pair", "sample", "s", "t", F.inline(names))
    ends = long.select("pair", "sample", "segment", *[F.element_at(side, F.col(end)).alias(side + end)
                                                      for side in "st" for end in "ab"])
    ends = ends.where(" AND ".join(f"{side}{end} IS NOT NULL" for side in "st" for end in "ab"))
    moves = ends.select("pair", "sample", "segment", *[(F.col(f"{side}b")[c] - F.col(f"{side}a")[c]).alias(side + c)
                                                       for side in "st" for c in "xyz"])
    angle = V.vector_angle_deg(*[tuple(F.col(side + c) for c in "xyz") for side in "st"])
    return moves.select("pair", "sample", "segment", angle.alias("deg")).where("deg IS NOT NULL")


def segment_error(angles: DataFrame) -> DataFrame:
    """Median and MAD of each (pair, segment)."""
    keys = ["pair", "segment"]
    median = scale.quantiles(angles, keys, {"median_deg": ("deg", 0.5)})
    away = angles.join(median, keys).select(*keys, F.abs(F.col("deg") - F.col("median_deg")).alias("away"))
    return median.join(scale.quantiles(away, keys, {"mad_deg": ("away", 0.5)}), keys)


def pair_error(angles: DataFrame, segments: Sequence[tuple[str, str]], fingers: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Overall median / p90, worst segment (first listed wins ties) and worst motion deviation per pair.

    Finger segments are summed up apart.  Arrays hold one value per segment, never one per sample.
    """
    names = [f"{a}->{b}" for a, b in segments]
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("segment"))
    body, hand = F.col("segment").isin(names), F.col("segment").isin([f"{a}->{b}" for a, b in fingers])
    only = lambda test, c: F.when(test, F.col(c))
    angles = stage(angles, "angles")
    g = segment_error(angles).groupBy("pair").agg(
        F.max_by(only(body, "segment"), F.when(body, F.struct("median_deg", -order))).alias("worst_segment"),
        F.max(only(body, "median_deg")).alias("worst_segment_deg"), F.max(only(body, "mad_deg")).alias("motion_deviation_deg"),
        F.count_if(body).alias("segments_compared"), F.count_if(hand).alias("finger_compared"),
        F.max(only(hand, "median_deg")).alias("finger_worst_deg"),
        sorted_median(F.array_sort(F.collect_list(only(hand, "median_deg")))).alias("finger_median_deg"))
    whole = scale.quantiles(angles.where(body), ["pair"], {"median_deg": ("deg", 0.5), "p90_deg": ("deg", 0.9)})
    return g.join(whole, "pair", "left")


def _chain_length(m: Column, chain: Sequence[str]) -> Column:
    length = F.lit(0.0)
    for a, b in zip(chain, chain[1:]):
        p, q = m[a], m[b]
        length = length + V.norm3(tuple(q[c] - p[c] for c in "xyz"))
    return length


def ground_stats(poses: DataFrame, roles: Sequence[str] = C.GROUND_ROLES, chain: Sequence[str] = C.SCALE_CHAIN) -> DataFrame:
    """One row per (pair, side): samples ``n``, body ``scale`` and per ground joint its lowest height, null unless the joint is
    seen in every sample and there is a scale.

    The scale is the length of the chain at sample 0, and 0 when a joint of the chain is missing there.
    """
    per = poses.groupBy("pair", "side", "sample").agg(*[
        F.max(F.when(F.col("role") == r, F.struct("x", "y", "z"))).alias(r) for r in dict.fromkeys([*roles, *chain])])
    length = _chain_length({r: F.col(r) for r in chain}, chain)
    g = per.groupBy("pair", "side").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("sample") == 0, length)), F.lit(0.0)).alias("scale"),
        *[F.count(r).alias(f"__c_{r}") for r in roles], *[F.min(F.col(r)["z"]).alias(f"__z_{r}") for r in roles])
    seen = {f"low_{r}": F.when((F.col(f"__c_{r}") == F.col("n")) & (F.col("scale") > 1e-6), F.col(f"__z_{r}")) for r in roles}
    return g.select("pair", "side", "n", "scale", *[c.alias(n) for n, c in seen.items()])


def pose_scale(poses: DataFrame, chain: Sequence[str] = C.SCALE_CHAIN) -> DataFrame:
    """Chain length at the first sample; 0 when a joint of the chain is missing."""
    return ground_stats(poses, (), chain).select("pair", "side", "scale")


def contact_metrics(poses: DataFrame, roles: Sequence[str] = C.GROUND_ROLES) -> DataFrame:
    """Median difference of foot height and share of samples whose ground contact differs."""
    stats = ground_stats(poses, roles)
    floor = F.array_min(F.array(*[f"low_{r}" for r in roles]))
    is_side = lambda s: F.col("side") == s
    both = stats.groupBy("pair").agg(*[F.max(F.when(is_side(s), c)).alias(f"{s}_{n}") for s in "st" for n, c in (
        ("floor", floor), ("scale", F.col("scale")), *((r, F.col(f"low_{r}")) for r in roles))])
    shared = F.array_compact(F.array(*[F.when(F.col(f"s_{r}").isNotNull() & F.col(f"t_{r}").isNotNull(), F.lit(r)) for r in roles]))
    limits = both.select("pair", *[f"{s}_{n}" for s in "st" for n in ("floor", "scale")], F.explode(shared).alias("role"))
    feet = poses.where(F.col("role").isin(list(roles))).groupBy("pair", "sample", "role").agg(*[
        F.max(F.when(is_side(s), F.col("z"))).alias(f"{s}_z") for s in "st"]).where("s_z IS NOT NULL AND t_z IS NOT NULL")
    height = lambda s: (F.col(f"{s}_z") - F.col(f"{s}_floor")) / F.col(f"{s}_scale")
    h = feet.join(limits, ["pair", "role"]).select("pair", height("s").alias("a"), height("t").alias("b"))
    h = h.withColumns({"gap": F.abs(F.col("a") - F.col("b")), "differs": (F.col("a") <= C.CONTACT_HEIGHT) != (F.col("b") <= C.CONTACT_HEIGHT)})
    h = stage(h.select("pair", "gap", "differs"), "heights")
    mismatch = h.groupBy("pair").agg((F.count_if("differs") / F.count(F.lit(1))).alias("contact_mismatch"))
    return scale.quantiles(h, ["pair"], {"foot_clearance_error": ("gap", 0.5)}).join(mismatch, "pair")


def foot_slide(poses: DataFrame, roles: Sequence[str] = C.GROUND_ROLES) -> DataFrame:
    """Median horizontal move between neighbouring samples while the foot is down, in body scales.

    Samples of a side count from 0 without gaps.
    """
    stats = ground_stats(poses, roles)
    lows = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"low_{r}").alias("low")) for r in roles])
    limits = stats.select("pair", "side", "scale", F.inline(lows)).where("low IS NOT NULL")
    feet = poses.where(F.col("role").isin(list(roles)))
    steps = scale.previous(feet, ["pair", "side", "role"], "sample", {"px": "x", "py": "y", "pz": "z"}).where("pz IS NOT NULL")
    limit = F.col("low") + F.col("scale") * C.CONTACT_HEIGHT
    moved = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2) / F.col("scale")
    down = steps.join(limits, ["pair", "side", "role"]).where((F.col("z") <= limit) & (F.col("pz") <= limit))
    return scale.quantiles(stage(down.select("pair", "side", moved.alias("moved")), "slides"), ["pair", "side"], {"foot_slide": ("moved", 0.5)})


def twist_range(twists: DataFrame) -> DataFrame:
    """Largest rotation away from the first sample per (pair, side, role); tracks of one sample have none."""
    keys = ["pair", "side", "role"]
    first = twists.groupBy(*keys).agg(F.min(F.struct("sample", "q")).alias("__f"))
    parts = lambda q: [F.get(q, F.lit(i)) for i in range(4)]
    turned = twists.join(first, keys).where(F.col("sample") > F.col("__f.sample"))
    return turned.groupBy(*keys).agg(F.max(V.quaternion_angle_deg(parts(F.col("__f.q")), parts(F.col("q")))).alias("deg"))


def twist_transfer(twists: DataFrame) -> DataFrame:
    """Compared and dropped twist roles and the worst ratio error per pair."""
    both = twist_range(twists).groupBy("pair", "role").agg(
        F.max(F.when(F.col("side") == "s", F.col("deg"))).alias("s"), F.max(F.when(F.col("side") == "t", F.col("deg"))).alias("t"))
    both = both.where("s IS NOT NULL AND t IS NOT NULL")
    moved = F.col("s") >= 5.0
    return both.groupBy("pair").agg(
        F.count(F.lit(1)).alias("twist_compared"), F.count_if(moved & (F.col("t") < 0.2 * F.col("s"))).alias("twist_dropped"),
        F.coalesce(F.max(F.when(moved, F.abs(F.col("t") / F.col("s") - 1.0))), F.lit(0.0)).alias("twist_ratio_error"))


def quality_rows(poses: DataFrame, twists: DataFrame, segments=C.SEGMENTS, fingers=None) -> DataFrame:
    """All metrics of a pair side by side; null means not measured."""
    fingers = fingers or [(f"{s}{f}1", f"{s}{f}2") for s in ("Left", "Right") for f in C.FINGER_NAMES]
    error = pair_error(segment_angles(poses, [*segments, *fingers]), segments, fingers)
    return (poses.select("pair").distinct().join(error, "pair", "left")
            .join(contact_metrics(poses), "pair", "left").join(twist_transfer(twists), "pair", "left"))


def quality_flags(rows: DataFrame, limits: dict = C.QUALITY_LIMITS) -> DataFrame:
    """Name every metric over its limit; pairs that were not measured are not judged."""
    over = lambda c: F.col(c) > limits[c]
    rules = {"worst_segment": over("worst_segment_deg"), "motion_deviation": over("motion_deviation_deg"),
             "foot_clearance": over("foot_clearance_error"), "contact": over("contact_mismatch"),
             "finger": over("finger_worst_deg"), "twist_dropped": F.col("twist_dropped") > 0,
             "twist_ratio": (F.col("twist_dropped") == 0) & over("twist_ratio_error")}
    measured = F.coalesce(F.col("segments_compared"), F.lit(0)) > 0
    reasons = F.array_compact(F.array(*[F.when(measured & t, F.lit(n)) for n, t in rules.items()]))
    return rows.withColumns({"measured": measured, "reasons": reasons, "needs_review": F.size(reasons) > 0})


def motion_features(pairs: DataFrame, subjects: DataFrame, keys: Sequence[str], ordinal: str = "i") -> DataFrame:
    """Net background motion and subject size change of each shot.

    pairs: (keys, i, scale, tx, ty); subjects: (keys, i, height, box, x) of the samples with a person.
    """
    keys = list(keys)
    step = scale.previous(pairs, keys, ordinal, {"__tx": "tx", "__ty": "ty"})
    flip = lambda a: F.coalesce((F.col(f"__{a}") * F.col(a) < 0) & (F.abs(f"__{a}") > 0.004) & (F.abs(a) > 0.004), F.lit(False))
    move = step.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.exp(F.sum(F.ln("scale"))).alias("net_scale"), F.sum("tx").alias("net_tx"),
        F.sum("ty").alias("net_ty"), F.sum(F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2)).alias("path"),
        (F.count_if(flip("tx")) + F.count_if(flip("ty"))).alias("direction_changes"))
    return move.join(_size_change(subjects, keys, ordinal), keys, "left")


def _size_change(subjects: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Change of the subject's size: medians of the late half over the early half, and the fitted growth over the shot.

    The middle sample of an odd number belongs to neither half.
    """
    line = scale.ordinal(subjects, keys, [ordinal], "__r", block=F.floor(F.col(ordinal) / scale.SPAN))
    whole = subjects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("height").alias("__h"), F.min("box").alias("__b"),
        F.min_by("x", ordinal).alias("x0"), F.max_by("x", ordinal).alias("x1"))
    half = F.floor(F.col("__n") / 2)
    halves = {f"__{part}_{c}": F.when(test, F.col(c)) for c in ("height", "box") for part, test in (
        ("early", F.col("__r") < half), ("late", F.col("__r") >= F.col("__n") - half))}
    kept = ["__n", "__h", "__b", "x0", "x1"]
    placed = stage(line.join(whole, keys).select(
        *keys, *kept, *[c.alias(n) for n, c in halves.items()], F.when(F.col("__h") > 0, F.ln("height")).alias("__log"),
        (F.col("__r") / F.greatest(F.lit(1), F.col("__n") - 1)).alias("__t")), "subjects")
    middles = scale.quantiles(placed, keys, {n: (n, 0.5) for n in halves})
    grown = placed.groupBy(*keys).agg(F.regr_slope("__log", "__t").alias("__slope"), *[F.first(c).alias(c) for c in kept])
    ratio = lambda c, low: F.when((F.col("__n") >= 3) & (F.col(low) > 0), F.col(f"__late_{c}") / F.col(f"__early_{c}"))
    return grown.join(middles, keys).select(
        *keys, ratio("height", "__h").alias("subject_scale"), ratio("box", "__b").alias("box_scale"),
        F.when(F.col("__n") >= 3, F.exp("__slope")).alias("subject_scale_full"),
        F.when(F.col("__n") >= 2, F.col("x1") - F.col("x0")).alias("subject_dx"))


def classify_motion(features: DataFrame) -> DataFrame:
    """Camera motion label; the order of the rules matters."""
    n, sc, tx, ty, path, dc = (F.col(c) for c in ("pairs", "net_scale", "net_tx", "net_ty", "path", "direction_changes"))
    ss, bs = F.col("subject_scale"), F.col("box_scale")
    straight = F.sqrt(tx * tx + ty * ty)
    label = (
        F.when((n >= 3) & (path > 0.05) & (F.abs(F.ln(F.greatest(sc, F.lit(1e-6)))) < 0.06)
               & ((dc >= 3) | (straight < path * 0.5)), "handheld")
        .when((n >= 4) & (dc >= 5) & (path > 0.3), "handheld")
        .when((ss > 1.08) & (bs > 1.04) & (ss > sc * 1.06), "dolly_in")
        .when((ss < 0.92) & (bs < 0.96) & (ss < sc / 1.06), "dolly_out")
        .when(sc > 1.06, "zoom_in").when(sc < 0.94, "zoom_out")
        .when((F.abs("subject_dx") < 0.04) & (F.abs(tx) > 0.06), "tracking")
        .when((F.abs(tx) > 0.06) | (F.abs(ty) > 0.06), F.when(F.abs(tx) >= F.abs(ty), "pan").otherwise("tilt"))
        .otherwise("static"))
    return features.withColumn("motion", label)


def motion_amount(labelled: DataFrame) -> DataFrame:
    """Size of the move; no amount for a static shot, subject scale only when measured."""
    moving = F.col("motion") != "static"
    amount = F.struct(F.col("net_tx").alias("screen_dx"), F.col("net_ty").alias("screen_dy"),
                      F.col("net_scale").alias("background_scale"), "path", F.col("pairs").alias("steps"),
                      F.coalesce("subject_scale_full", "subject_scale").alias("subject_scale"))
    return labelled.withColumn("amount", F.when(moving, amount))


def camera_angle_vote(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Angle label and confidence from three cues (nose, horizon, head) of upright samples."""
    up = samples.where("NOT tilted")
    cues = scale.quantiles(up, list(keys), {"nose": ("nose", 0.5), "horizon": ("horizon", 0.5), "head": ("head", 0.5)})
    every = samples.groupBy(*keys).agg(F.first("focus_ratio").alias("focus_ratio"))
    c = every.join(cues, list(keys), "left")
    low = F.when(F.col("focus_ratio").isNull(), 0.4).otherwise(F.col("focus_ratio") * 0.8 - 0.15)
    nose, horizon = F.col("nose"), F.col("horizon")
    vote = lambda a, s: F.struct(F.lit(a).alias("angle"), F.lit(s).alias("confidence"))
    picked = (F.when(nose < -0.15, vote("overhead", 0.7)).when(horizon < low, vote("low", 0.75))
              .when(horizon > 0.9, vote("high", 0.75)).when(horizon.isNotNull(), vote("eye", 0.75))
              .when(nose > 0.37, vote("low", 0.45)).when(nose < 0.2, vote("high", 0.45)).when(nose.isNotNull(), vote("eye", 0.45))
              .when(F.col("head") > 0.25, vote("overhead", 0.5)).otherwise(vote("eye", 0.3)))
    return c.withColumn("__v", picked).select(*keys, "__v.angle", "__v.confidence")


def side_majority(candidates: DataFrame, detected: DataFrame, keys: Sequence[str], sample: str) -> DataFrame:
    """Side most samples agree on (left wins ties), kept when it holds in half of the detected samples.

    candidates: (keys, sample, side, x0, x1, height, area, probability); detected: (keys, n_detected).
    """
    keys = list(keys)
    pick = F.max_by(F.struct("side", "x0", "x1", "height", "probability"), F.struct("area", -F.col("ord")))
    per = stage(candidates.groupBy(*keys, sample).agg(pick.alias("c")).select(*keys, "c.*").where(F.col("side").isin("left", "right")).withColumns(
        {"cx": (F.col("x0") + F.col("x1")) / 2, "cw": F.col("x1") - F.col("x0")}), "sides")
    # both sides are summed up, a row each, and the larger one is taken: the rows of a side never meet its votes
    med = scale.quantiles(per, [*keys, "side"], {"screen_x": ("cx", 0.5), "screen_width": ("cw", 0.5), "screen_height": ("height", 0.5)})
    agg = per.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("p"))
    both = agg.join(med, [*keys, "side"])
    fields = [c for c in both.columns if c not in keys]
    chosen = both.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct("n", F.col("side") == "left")).alias("c")).select(*keys, "c.*")
    out = chosen.join(detected, keys).where(F.col("n") * 2 >= F.col("n_detected"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / F.col("n_detected")) * F.col("p")).drop("p", "n_detected")


def shot_summary(samples: DataFrame, shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians, coverage and confidence of each shot; a fallback row when nobody was detected.

    samples: (keys, detected, height, focus_x, focus_y, box_width, score, people); shots: (keys, motion).
    """
    keys = list(keys)
    seen = samples.where("detected")
    med = scale.quantiles(seen, keys, {n: (n, 0.5) for n in ("height", "focus_x", "focus_y", "box_width")})
    agg = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if("detected").alias("found"),
                                     F.max("people").alias("people_max"))
    var = seen.groupBy(*keys).agg(F.avg("score").alias("quality"), F.stddev_pop("height").alias("sd"), F.avg("height").alias("mean"),
                                  F.stddev_pop("focus_x").alias("sx"))
    j = shots.join(agg, keys, "left").join(med, keys, "left").join(var, keys, "left")
    one = F.lit(1.0)
    wobble = 0.5 * F.least(one, F.col("sd") / F.greatest(F.lit(1e-6), F.col("mean")) * 4.0) + 0.3 * F.least(one, F.col("sx") * 8.0)
    steady = F.when((F.col("motion") == "static") & (F.col("found") >= 2), 1.0 - wobble).otherwise(one)
    confidence = 0.15 + 0.85 * F.least(one, F.col("quality")) * (F.col("found") / F.greatest(F.lit(1), F.col("samples"))) * F.greatest(F.lit(0.0), steady)
    none = F.coalesce("found", F.lit(0)) == 0
    keep = lambda c, d: F.when(none, d).otherwise(F.col(c))
    return j.select(*keys, keep("height", None).alias("height"), keep("focus_x", 0.5).alias("focus_x"), keep("focus_y", 0.5).alias("focus_y"),
                    keep("box_width", 0.3).alias("box_width"), F.coalesce("found", F.lit(0)).alias("found"),
                    F.when(none, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(one, confidence))).alias("confidence"),
                    F.when(none, 0).otherwise(F.col("people_max")).alias("people_max"))


def group_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary per source -> target combination (or of everything, with no keys)."""
    keys = list(keys)
    med = scale.quantiles(rows, keys, {"segment_angle_median_deg": ("median_deg", 0.5), "finger_angle_median_deg": ("finger_median_deg", 0.5)})
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.max("worst_segment_deg").alias("worst_segment_deg"),
        F.max_by("worst_segment", F.struct("worst_segment_deg", -F.col("ord"))).alias("worst_segment"),
        F.max("foot_clearance_error").alias("foot_clearance_worst"), F.max("contact_mismatch").alias("contact_mismatch_worst"),
        F.max("motion_deviation_deg").alias("motion_deviation_worst_deg"), F.count("finger_median_deg").alias("pairs_with_fingers"))
    if keys:
        return agg.join(med, keys)
    return agg.withColumns({c: med.select(c).scalar() for c in med.columns})


def motion_extent(tracks: DataFrame, keys: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """Largest axis extent of any named track; tells frozen captures from moving ones."""
    per = tracks.where(F.col("role").isin(list(roles))).groupBy(*keys, "role").agg(
        *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.groupBy(*keys).agg(F.max(F.greatest("x", "y", "z")).alias("extent"))


def step_median(tracks: DataFrame, keys: Sequence[str], roles: Sequence[str], ordinal: str = "sample") -> DataFrame:
    """Upper median of the largest axis step between neighbouring samples; samples count from 0 without gaps."""
    keys = list(keys)
    t = tracks.where(F.col("role").isin(list(roles)))
    steps = scale.previous(t, [*keys, "role"], ordinal, {f"__{c}": c for c in "xyz"}).where("__x IS NOT NULL")
    largest = steps.select(*keys, F.greatest(*[F.abs(F.col(c) - F.col(f"__{c}")) for c in "xyz"]).alias("s"))
    return scale.quantiles(stage(largest, "steps"), keys, {"step": ("s", 0.5)}, upper=["step"])


def active_curves(curves: DataFrame, curve: Sequence[str], value: str = "value", top: int = 12) -> DataFrame:
    """The most active curves with the number of curves that move at all."""
    ranges = curves.groupBy(*curve).agg((F.max(value) - F.min(value)).alias("range")).where("range > 0.01")
    total = ranges.agg(F.count(F.lit(1)).alias("moving"))
    best = ranges.orderBy(F.desc("range"), *curve).limit(top)
    return best.withColumn("moving", total.scalar())


def rule_check(metrics: DataFrame, rules: DataFrame, skips: DataFrame, errors: DataFrame) -> DataFrame:
    """Regression gate: OK / FAIL / SKIP per rule.

    metrics (suite, path, value), rules (suite, path, op, bound), skips (suite,
    path) mark a skipped subtree, errors (suite) a suite that did not run.  A
    missing metric fails.
    """
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    above = rules.withColumn("prefix", F.explode(prefixes)).join(
        skips.select("suite", F.col("path").alias("prefix")), ["suite", "prefix"], "left_semi").select("suite", "path").distinct()
    j = (rules.join(metrics, ["suite", "path"], "left")
         .join(above.withColumn("__skip", F.lit(True)), ["suite", "path"], "left")
         .join(errors.select("suite").withColumn("__err", F.lit(True)), "suite", "left"))
    good = (F.when(F.col("op") == "min", F.col("value") >= F.col("bound"))
            .when(F.col("op") == "max", F.col("value") <= F.col("bound")).otherwise(F.col("value") == F.col("bound")))
    status = (F.when(F.col("__err"), "FAIL").when(F.col("__skip"), "SKIP").when(F.col("value").isNull(), "FAIL")
              .when(good, "OK").otherwise("FAIL"))
    return j.select("suite", "path", "op", "value", status.alias("status"))
