"""Scorecards of analysis results against truth, and picture statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise import constants as C
from framewise import scale
from framewise.operators import metrics as M


def truth_scorecard(matched: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Hits and mean errors per video plus one row per miss (never a list in one row).

    matched: one row per truth shot with found, size, true_size (may be null), motion,
    true_motion, people_max, x, y, true_x, true_y, height, true_height, start, true_start.
    """
    keys = list(keys)
    person = F.coalesce(F.col("people_max"), F.lit(1)) > 0
    compared = F.col("found") & F.col("true_size").isNotNull()
    right = F.col("size") == F.col("true_size")
    aimed = F.col("found") & person & (F.col("true_size").isNull() | right)
    m = matched.withColumns({
        "__aim": aimed, "__nobody": F.col("found") & ~person, "__miss": compared & person & ~right})
    card = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shots"), F.count_if("found").alias("matched"), F.count_if(compared).alias("size_compared"),
        F.count_if(compared & right).alias("size_hits"), F.count_if(F.col("found") & (F.col("motion") == F.col("true_motion"))).alias("motion_hits"),
        F.count_if("__nobody").alias("no_person"), F.count_if("__aim").alias("aim_compared"),
        F.avg(F.when(F.col("__aim"), F.abs(F.col("x") - F.col("true_x")))).alias("mean_x_error"),
        F.avg(F.when(F.col("__aim"), F.abs(F.col("y") - F.col("true_y")))).alias("mean_y_error"),
        F.avg(F.when(F.col("found") & (F.col("height") != 0), F.col("height") / F.col("true_height"))).alias("mean_height_ratio"),
        F.avg(F.when(F.col("found"), F.abs(F.col("start") - F.col("true_start")))).alias("mean_boundary_error"))
    kind = F.when(~F.col("found"), "no_match").when(F.col("__nobody"), "no_person").when(F.col("__miss"), "size")
    misses = m.select(*keys, "name", kind.alias("miss")).where("miss IS NOT NULL")
    return card, misses


def angle_scorecard(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact and neighbouring angle hits; an image without a person has a null angle."""
    at = lambda c: F.array_position(F.array(*[F.lit(a) for a in C.ANGLE_ORDER]), F.col(c))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("angle") == F.col("expected")).alias("exact"),
        F.count_if(F.abs(at("angle") - at("expected")) <= 1).alias("adjacent"),
        F.count_if(F.coalesce(F.col("angle") != F.col("expected"), F.lit(True))).alias("misses"))


def height_scorecard(rows: DataFrame, dataset: str) -> DataFrame:
    """Relative height error: everything, full or cropped bodies, per dataset, and the worst dataset.

    rows: estimated (null without a person), truth, cropped.
    """
    r = rows.withColumns({"__s": (F.col("estimated") - F.col("truth")) / F.col("truth")}).withColumn("__e", F.abs("__s"))
    groups = F.array(F.struct(F.lit("all").alias("part"), F.lit("").alias("name")),
                     F.struct(F.when(F.col("cropped"), "cropped").otherwise("full_body").alias("part"), F.lit("").alias("name")),
                     F.struct(F.lit("dataset").alias("part"), F.col(dataset).cast("string").alias("name")))
    g = r.select("__s", "__e", F.inline(groups))
    q = scale.quantiles(g, ["part", "name"], {"median_err": ("__e", 0.5), "p90_err": ("__e", 0.9), "bias": ("__s", 0.5)})
    n = g.groupBy("part", "name").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("__e").isNull()).alias("without_person"))
    per = n.join(q, ["part", "name"], "left")
    worst = per.where("part = 'dataset'").agg(F.max("median_err").alias("median_err")).select(
        F.lit("worst_dataset").alias("part"), F.lit("").alias("name"), F.lit(None).cast("bigint").alias("frames"),
        F.lit(None).cast("bigint").alias("without_person"), "median_err", F.lit(None).cast("double").alias("p90_err"), F.lit(None).cast("double").alias("bias"))
    return per.unionByName(worst)


def size_scorecard(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bias, spread and position error per group; groups where nothing was found stay.

    rows: log_ratio and position, null when nothing was found.
    """
    keys = list(keys)
    found = rows.where("log_ratio IS NOT NULL")
    stats = M.robust_stats(found, keys, "log_ratio")
    pos = scale.quantiles(found, keys, {"position_median": ("position", 0.5)})
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("log_ratio").alias("found"), F.max(
        F.when(F.col("log_ratio").isNotNull(), F.col("position"))).alias("position_max"))
    return agg.join(stats.drop("n", "p90", "mad"), keys, "left").join(pos, keys, "left").withColumn("bias", F.exp("median")).drop("median")


def role_consistency(rows: DataFrame, keys: Sequence[str], role: str, label: str) -> DataFrame:
    """Every role stands for one label and no label is shared."""
    keys = list(keys)
    pairs = rows.groupBy(*keys, role, label).agg(F.count(F.lit(1)).alias("n"))
    roles = pairs.groupBy(*keys, role).agg(F.count(F.lit(1)).alias("labels"))
    labels = pairs.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("roles"))
    single = roles.groupBy(*keys).agg(F.max("labels").alias("a"))
    distinct = labels.groupBy(*keys).agg(F.max("roles").alias("b"))
    return single.join(distinct, keys).select(*keys, ((F.col("a") == 1) & (F.col("b") == 1)).alias("consistent"))


def roundtrip_scorecard(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors of re-measured motion; handheld has no direction and is left out of dx."""
    keys = list(keys)
    directed = F.col("motion") != "handheld"
    r = rows.withColumns({"__dx": F.when(directed, F.col("dx_error")),
                          "__log": F.when(F.col("scale_ratio") != 0, F.abs(F.ln("scale_ratio")))})
    med = scale.quantiles(r, keys, {"dx_error_median": ("__dx", 0.5)})
    agg = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("motion_shots"), F.max("__dx").alias("dx_error_worst"), F.max("__log").alias("scale_log_error_worst"),
        F.count_if(directed & F.col("dx_error").isNull() & F.col("scale_ratio").isNull()).alias("unmeasured"))
    return agg.join(med, keys, "left")


def depth_correlation(rows: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Pearson correlation; null for a flat prediction or fewer than three rows."""
    both = F.col(truth).isNotNull() & F.col(predicted).isNotNull()
    a, b = F.when(both, F.col(truth)), F.when(both, F.col(predicted))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    ok = (F.stddev_pop(b) > 1e-9) & (F.count(b) > 2) & (spread > 0)
    return rows.groupBy(*keys).agg(F.when(ok, F.covar_pop(a, b) / F.when(spread > 0, spread)).alias("correlation"), F.count(b).alias("n"))


def skeleton_audit(roles: DataFrame, bones: DataFrame, readiness: DataFrame) -> DataFrame:
    """One row per mesh with its tier. roles: (mesh, confidence, forced); readiness: (mesh, readiness)."""
    r = roles.groupBy("mesh").agg(F.count(F.lit(1)).alias("mapped_roles"), F.count_if(F.col("confidence") < 0.6).alias("low_confidence_roles"),
                                  F.count_if("forced").alias("forced_roles"))
    b = bones.groupBy("mesh").agg(F.count(F.lit(1)).alias("bones"))
    tier = F.when(F.col("readiness") >= 0.90, "A").when(F.col("readiness") >= 0.70, "B").otherwise("C")
    j = b.join(r, "mesh", "left").join(readiness, "mesh", "left").withColumn("tier", tier)
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("mapped_roles", "low_confidence_roles", "forced_roles")})


def tier_histogram(audit: DataFrame) -> DataFrame:
    return audit.rollup("tier").agg(F.count(F.lit(1)).alias("meshes"), F.avg("readiness").alias("readiness")).select(
        F.coalesce("tier", F.lit("all")).alias("tier"), "meshes", "readiness")


def weighted_checklist(ref_shots: DataFrame, cine_shots: DataFrame, plans: DataFrame, key: str, ordinal: str) -> DataFrame:
    """0..100 share of passed checks of a rebuilt plan; one row per row of ``plans``.

    ref_shots: duration, motion, role, subjects, confidence; cine_shots: duration,
    motion, subject, placements; plans: ref_aspect, cine_aspect.  Passed and tried checks are counted as integers and the mean
    confidence is compared as an exact decimal sum, so the score doesn't depend on the order of rows.
    """
    there = F.lit(True)
    c = cine_shots.select(key, ordinal, there.alias("__cine"), *[F.col(x).alias(f"c_{x}") for x in ("duration", "motion", "subject", "placements")])
    j = ref_shots.select(key, ordinal, there.alias("__ref"), "duration", "motion", "role", "subjects", "confidence").join(c, [key, ordinal], "full_outer")
    pair = F.col("__ref") & F.col("__cine")
    many = pair & (F.col("subjects") > 1)
    checks = {"d": (pair, F.abs(F.col("duration") - F.col("c_duration")) <= 0.05), "m": (pair, (F.col("motion") == "") | (F.col("motion") == F.col("c_motion"))),
              "s": (pair, (F.col("role") == "") | (F.col("c_subject") != "")), "p": (many, F.col("c_placements") >= F.col("subjects"))}
    counted = j.groupBy(key).agg(
        F.count("__ref").alias("r"), F.count("__cine").alias("c"), F.count("confidence").alias("known"), F.sum(F.col("confidence").cast("decimal(20,9)")).alias("sure"),
        F.count_if(pair).alias("tried"), F.count_if(many).alias("crowded"), *[F.count_if(tried & passed).alias(n) for n, (tried, passed) in checks.items()])
    h = plans.join(counted, key, "left").fillna(0, ["r", "c", "known", "tried", "crowded", *checks])
    n = F.greatest(F.lit(1), F.least("r", "c"))
    sure = F.coalesce((F.col("known") > 0) & (F.col("sure") >= F.col("known") * F.lit("0.55").cast("decimal(3,2)")), F.lit(False))
    whole = [(20, (F.col("r") > 0) & (F.col("r") == F.col("c"))), (15, F.abs(F.col("ref_aspect") - F.col("cine_aspect")) <= 0.01), (15, sure)]
    passed = sum((F.when(test, weight).otherwise(0) for weight, test in whole[1:]), F.when(whole[0][1], whole[0][0]).otherwise(0))
    shots = 10 * F.col("d") + 15 * F.col("m") + 15 * F.col("s") + 20 * F.col("p")
    # numerator and denominator of the share, both times n
    return h.select(key, (100 * (passed * n + shots) / (50 * n + 40 * F.col("tried") + 20 * F.col("crowded"))).alias("score"))


def active_area(frames: DataFrame, keys: Sequence[str], sig: str, width: int, height: int, unit: float = 1.0) -> DataFrame:
    """Picture area without the still bars at its edges; null columns when there are no bars.

    One partial aggregate per pixel, then per line; the frames of one video never meet in one task.
    """
    keys = list(keys)
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    px = frames.select(*keys, F.posexplode(sig).alias("i", "v")).groupBy(*keys, "i").agg(
        (F.stddev_pop("v") * unit).alias("sd"), (F.avg("v") * unit).alias("mean"))
    lines = F.array(F.struct(F.lit("y").alias("axis"), F.floor(F.col("i") / width).alias("line")),
                    F.struct(F.lit("x").alias("axis"), (F.col("i") % width).cast("bigint").alias("line")))
    per = px.select(*keys, "sd", "mean", F.inline(lines)).groupBy(*keys, "axis", "line").agg(
        F.percentile("sd", F.lit(0.9)).alias("sd"), F.avg("mean").alias("mean"))
    still = (F.col("sd") < 4.0) & ((F.col("mean") < 60.0) | (F.col("sd") < 2.5))
    live = per.where(~still).groupBy(*keys).agg(*[
        f(F.when(F.col("axis") == a, F.col("line"))).alias(f"{a}{e}") for a in "xy" for e, f in ((0, F.min), (1, F.max))])
    j = n.join(live, keys, "left")
    w, h = F.coalesce(F.col("x1") + 1 - F.col("x0"), F.lit(0)), F.coalesce(F.col("y1") + 1 - F.col("y0"), F.lit(0))
    keep = (h >= 0.3 * height) & (w >= 0.3 * width) & ~((h > 0.95 * height) & (w > 0.95 * width))
    return j.select(*keys, *[F.when(keep, F.col(a) + e).alias(a) for a, e in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))])


def frame_difference(a: Column, b: Column, width: int, height: int) -> Column:
    """Mean absolute difference over the central 80 percent of two pictures in row order; 0 when one is missing."""
    inside = [y * width + x for y in range(int(height * 0.1), int(height * 0.9)) for x in range(int(width * 0.1), int(width * 0.9))]
    gaps = F.transform(F.array(*[F.lit(i) for i in inside]), lambda i: F.abs(F.get(a, i) - F.get(b, i)))
    return F.coalesce(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / len(inside), F.lit(0.0))


def strongest_row(frames: DataFrame, keys: Sequence[str], grad: str, mask: str, width: int, height: int) -> DataFrame:
    """Row with the strongest mean gradient outside the masked pixels, and its contrast to the median row.

    The pixels of a frame are one row, so this runs without a shuffle.
    """
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.struct(
        y.alias("y"),
        F.aggregate(F.slice(mask, y * width + 1, F.lit(width)), F.lit(0.0), lambda s, m: s + m).alias("valid"),
        F.aggregate(F.zip_with(F.slice(grad, y * width + 1, F.lit(width)), F.slice(mask, y * width + 1, F.lit(width)), lambda g, m: g * m),
                    F.lit(0.0), lambda s, g: s + g).alias("sum")))
    usable = lambda r: r["valid"] > width * 0.12
    f = frames.withColumn("__r", F.transform(rows, lambda r: F.struct(
        r["y"].alias("y"), usable(r).alias("ok"), F.when(usable(r), r["sum"] / F.greatest(F.lit(1.0), r["valid"])).otherwise(F.lit(0.0)).alias("s"))))
    margin = int(height * 0.03)
    inner = F.filter("__r", lambda r: (r["y"] >= margin) & (r["y"] < height - margin))
    best = F.array_max(F.transform(inner, lambda r: F.struct(r["s"].alias("s"), (-r["y"]).alias("y"))))
    med = M.sorted_median(F.array_sort(F.transform(F.filter("__r", lambda r: r["ok"]), lambda r: r["s"])))
    seen = F.exists("__r", lambda r: r["s"] > 0)
    return f.select(*keys, F.when(seen, -best["y"]).alias("row"), F.when(seen, best["s"] / (med + 1e-6)).alias("contrast"))


def band_median_point(bones: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Focus point of each body: upper median of the bones near the focus height, else the centre.

    bones: (key, x, y, z); bodies: (key, cx, cy, z0, z1, ratio).
    """
    tall = F.col("z1") - F.col("z0")
    at = F.col("z0") + tall * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio")))
    j = bones.join(bodies, key)
    flat = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    near = j.where((F.abs(F.col("z") - at) <= F.greatest(F.lit(6.0), tall * 0.06)) & (flat <= tall * 0.15))
    a = near.groupBy(key).agg(*[F.array_sort(F.collect_list(c)).alias(f"a{c}") for c in "xy"])
    out = bodies.join(a, key, "left")
    mid = lambda c: F.get(f"a{c}", F.floor(F.size(f"a{c}") / 2).cast("int"))
    enough = F.coalesce(F.size("ax") >= 2, F.lit(False))
    return out.select(key, *[F.when(enough, mid(c)).otherwise(F.col(f"c{c}")).alias(c) for c in "xy"], at.alias("z"))


def search_scorecard(results: DataFrame, expected: DataFrame, no_match: float = 40.0) -> DataFrame:
    """Did each prompt find its video first? A prompt without a video passes when nothing scores high.

    results: (prompt, rank, video, score); expected: (prompt, video or null).
    """
    top = results.where("rank = 1").select("prompt", F.col("video").alias("found"), "score")
    j = expected.join(top, "prompt", "left")
    ok = F.when(F.col("video").isNull(), F.col("found").isNull() | (F.col("score") < no_match)).otherwise(
        F.coalesce(F.col("video") == F.col("found"), F.lit(False)))
    return j.select("prompt", "video", "found", ok.alias("passed"))
