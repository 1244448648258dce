"""Scorecards and picture statistics over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise import constants as C
from framewise import scale
from framewise.operators import intervals as I
from framewise.operators import joins as J
from framewise.operators import scorecards as SC
from framewise.plans import bindings as B
from framewise.plans.q_functions import r6
from framewise.plans.q_joins import SQL_SESSIONS, day_bins, sessions
from framewise.plans.registry import query, table

SQL_MATCH = SQL_SESSIONS + """, o AS (SELECT se.reel, se.session, se."start" AS ts, se.k, dy.day, least(se."end", (dy.day + 1) * 86400) - greatest(se."start", dy.day * 86400) AS ov FROM se JOIN dy USING (reel)),
b AS (SELECT * FROM o WHERE ov > 0 QUALIFY row_number() OVER (PARTITION BY reel, session ORDER BY ov DESC, day) = 1),
ma AS (SELECT se.reel, se.session, b.day IS NOT NULL AS found, (['wide', 'full', 'medium'])[b.day % 3 + 1] AS size, CASE WHEN se.k % 4 <> 0 THEN (['wide', 'full', 'medium'])[se.k % 3 + 1] END AS tsize,
 (['pan', 'static'])[b.day % 2 + 1] AS motion, (['pan', 'static'])[se.k % 2 + 1] AS tmotion, b.day % 4 AS pm, (b.day % 7) / 7 AS x, se.k / 100.0 AS tx, b.day * 86400.0 AS st, se."start" AS tst FROM se LEFT JOIN b USING (reel, session)),
fl AS (SELECT *, found AND tsize IS NOT NULL AS cmp, found AND pm > 0 AND (tsize IS NULL OR size = tsize) AS aim FROM ma)"""


def matched(spark, sf):
    m = I.best_overlap(sessions(spark, sf), day_bins(spark, sf), ["reel"], "session", "day", 86400.0)
    pick = lambda c, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs)).cast("int"))
    return m.select(
        "reel", F.concat(F.lit("S"), "session").alias("name"), F.col("day").isNotNull().alias("found"), pick("day", "wide", "full", "medium").alias("size"),
        F.when(F.col("k") % 4 != 0, pick("k", "wide", "full", "medium")).alias("true_size"), pick("day", "pan", "static").alias("motion"), pick("k", "pan", "static").alias("true_motion"),
        (F.col("day") % 4).alias("people_max"), ((F.col("day") % 7) / 7).alias("x"), F.lit(0.5).alias("y"), (F.col("k") / 100.0).alias("true_x"), F.lit(0.5).alias("true_y"),
        F.lit(1.0).alias("height"), F.lit(2.0).alias("true_height"), (F.col("day") * 86400.0).alias("start"), F.col("start").alias("true_start"))


@query("a20_truth_scorecard", f"""WITH {SQL_MATCH} SELECT reel, count(*) AS shots, count(*) FILTER (WHERE found) AS matched, count(*) FILTER (WHERE cmp) AS size_compared, count(*) FILTER (WHERE cmp AND size = tsize) AS size_hits,
 count(*) FILTER (WHERE found AND motion = tmotion) AS motion_hits, count(*) FILTER (WHERE found AND pm = 0) AS no_person, count(*) FILTER (WHERE aim) AS aim_compared, round(avg(abs(x - tx)) FILTER (WHERE aim), 6) AS mean_x_error,
 round(avg(abs(st - tst)) FILTER (WHERE found), 4) AS mean_boundary_error FROM fl GROUP BY reel""")
def _(spark, sf):
    card, _misses = SC.truth_scorecard(matched(spark, sf), ["reel"])
    return card.select("reel", "shots", "matched", "size_compared", "size_hits", "motion_hits", "no_person", "aim_compared",
                       r6(F.col("mean_x_error")).alias("mean_x_error"), F.round("mean_boundary_error", 4).alias("mean_boundary_error"))


@query("a20_truth_misses", f"""WITH {SQL_MATCH} SELECT reel, 'S' || session AS name, CASE WHEN NOT found THEN 'no_match' WHEN pm = 0 THEN 'no_person' ELSE 'size' END AS miss FROM fl WHERE NOT found OR pm = 0 OR (cmp AND size <> tsize)""")
def _(spark, sf):
    return SC.truth_scorecard(matched(spark, sf), ["reel"])[1]


@query("a21_angle_scorecard", f"""WITH r AS (SELECT source, ({C.ANGLE_ORDER})[quality * 2 + toxic + 1] AS expected, CASE WHEN n_chars % 11 <> 0 THEN ({C.ANGLE_ORDER})[n_chars % 4 + 1] END AS angle FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS total, count(*) FILTER (WHERE angle = expected) AS exact, count(*) FILTER (WHERE abs(list_position({C.ANGLE_ORDER}, angle) - list_position({C.ANGLE_ORDER}, expected)) <= 1) AS adjacent,
 count(*) FILTER (WHERE angle IS DISTINCT FROM expected) AS misses FROM r GROUP BY source""")
def _(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    order = F.array(*[F.lit(a) for a in C.ANGLE_ORDER])
    rows = j.select("source", F.get(order, (F.col("quality") * 2 + F.col("toxic")).cast("int")).alias("expected"),
                    F.when(F.col("n_chars") % 11 != 0, F.get(order, (F.col("n_chars") % 4).cast("int"))).alias("angle"))
    return SC.angle_scorecard(rows, ["source"])


@query("a22_height_scorecard", """WITH r AS (SELECT l_returnflag AS d, l_linestatus = 'O' AS cropped, CASE WHEN l_linenumber <> 7 THEN (l_extendedprice / 1000 - l_quantity) / l_quantity END AS s FROM lineitem),
g AS (SELECT 'all' AS part, '' AS name, s FROM r UNION ALL SELECT CASE WHEN cropped THEN 'cropped' ELSE 'full_body' END, '', s FROM r UNION ALL SELECT 'dataset', d, s FROM r),
a AS (SELECT part, name, count(*) AS frames, count(*) FILTER (WHERE s IS NULL) AS without_person, median(abs(s)) AS m, quantile_cont(abs(s), 0.9) AS p, median(s) AS b FROM g GROUP BY ALL)
SELECT part, name, frames, without_person, round(m, 6) AS median_err, round(p, 6) AS p90_err, round(b, 6) AS bias FROM a UNION ALL SELECT 'worst_dataset', '', NULL, NULL, round(max(m), 6), NULL, NULL FROM a WHERE part = 'dataset'""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").alias("cropped"), F.col("l_quantity").alias("truth"),
                                               F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000).alias("estimated"))
    out = SC.height_scorecard(rows, "l_returnflag")
    return out.withColumns({c: r6(F.col(c)) for c in ("median_err", "p90_err", "bias")})


@query("a23_size_scorecard", """WITH r AS (SELECT l_linenumber AS angle, l_returnflag AS size, CASE WHEN l_linenumber < 7 AND l_quantity > 5 THEN ln(l_extendedprice / 50000) END AS lr, l_discount * 2 AS pos FROM lineitem),
m AS (SELECT *, median(lr) OVER (PARTITION BY angle, size) AS med FROM r)
SELECT angle, size, count(*) AS total, count(lr) AS found, round(exp(med), 6) AS bias, round(1.4826 * median(abs(lr - med)), 6) AS spread, round(max(abs(lr - med)), 6) AS max_deviation, round(median(CASE WHEN lr IS NOT NULL THEN pos END), 6) AS position_median,
 round(max(CASE WHEN lr IS NOT NULL THEN pos END), 6) AS position_max FROM m GROUP BY angle, size, med""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("angle"), F.col("l_returnflag").alias("size"), (F.col("l_discount") * 2).alias("position"),
        F.when((F.col("l_linenumber") < 7) & (F.col("l_quantity") > 5), F.ln(F.col("l_extendedprice") / 50000)).alias("log_ratio"))
    out = SC.size_scorecard(rows, ["angle", "size"])
    return out.withColumns({c: r6(F.col(c)) for c in ("bias", "spread", "max_deviation", "position_median", "position_max")})


@query("a24_role_consistency", """WITH p AS (SELECT DISTINCT conv_id, role, CASE WHEN conv_id % 3 = 0 THEN turn % 2 ELSE ascii(role) END AS label FROM conversations),
a AS (SELECT conv_id, max(n) AS n FROM (SELECT conv_id, role, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), b AS (SELECT conv_id, max(n) AS n FROM (SELECT conv_id, label, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1)
SELECT conv_id, a.n = 1 AND b.n = 1 AS consistent FROM a JOIN b USING (conv_id)""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("label", F.when(F.col("conv_id") % 3 == 0, F.col("turn") % 2).otherwise(F.ascii("role")))
    return SC.role_consistency(c, ["conv_id"], "role", "label")


@query("a25_roundtrip_scorecard", f"""WITH {B.ES}, e AS (SELECT event_type, ({B.MOTION_OF_REST})[k % 10 + 1] AS motion, CASE WHEN k % 3 <> 0 THEN abs(value - 30) / 1000 END AS dx, CASE WHEN k % 4 = 0 THEN (value + 50) / 100 END AS sr FROM ev)
SELECT event_type, count(*) AS motion_shots, round(median(CASE WHEN motion <> 'handheld' THEN dx END), 6) AS dx_error_median, round(max(CASE WHEN motion <> 'handheld' THEN dx END), 6) AS dx_error_worst, round(max(abs(ln(sr))), 6) AS scale_log_error_worst,
 count(*) FILTER (WHERE motion <> 'handheld' AND dx IS NULL AND sr IS NULL) AS unmeasured FROM e GROUP BY event_type""")
def _(spark, sf):
    ev = B.event_series(spark, sf)
    motion = F.get(F.array(*[F.lit(m) for m in B.MOTION_OF_REST]), F.col("k") % 10)
    rows = ev.select("event_type", motion.alias("motion"), F.when(F.col("k") % 3 != 0, F.abs(F.col("value") - 30) / 1000).alias("dx_error"),
                     F.when(F.col("k") % 4 == 0, (F.col("value") + 50) / 100).alias("scale_ratio"))
    out = SC.roundtrip_scorecard(rows, ["event_type"])
    return out.withColumns({c: r6(F.col(c)) for c in ("dx_error_median", "dx_error_worst", "scale_log_error_worst")})


@query("a26_depth_correlation", """SELECT l_suppkey, CASE WHEN stddev_pop(p) > 1e-9 AND count(p) > 2 THEN round(corr(l_extendedprice, p), 6) END AS correlation, count(p) AS n FROM (SELECT l_suppkey, l_extendedprice, CASE WHEN l_suppkey % 10 = 0 THEN 1.0 ELSE l_quantity END::DOUBLE AS p FROM lineitem) GROUP BY l_suppkey""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("p", F.when(F.col("l_suppkey") % 10 == 0, 1.0).otherwise(F.col("l_quantity")))
    return SC.depth_correlation(li, ["l_suppkey"], "l_extendedprice", "p").withColumn("correlation", r6(F.col("correlation")))


@query("a31_weighted_checklist", f"""WITH {B.LS}, rf AS (SELECT plan, shot_idx, l_orderkey AS ok, l_quantity / 10 AS dur, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'pan' ELSE 'tilt' END AS motion, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'm' END AS role, (l_suppkey % 3)::INT AS subs, l_discount * 12 AS conf FROM ls),
ci AS (SELECT plan, shot_idx, l_quantity / 10 + CASE WHEN l_suppkey % 5 = 0 THEN 0.2 ELSE 0 END AS dur, CASE WHEN l_suppkey % 2 = 0 THEN 'pan' ELSE 'tilt' END AS motion, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'h' END AS subj, (l_partkey % 4)::INT AS pla FROM ls WHERE l_linenumber < 7 OR shot_idx = 0),
pl AS (SELECT plan, any_value(ok) AS ok, count(*) AS r, sum(conf::DECIMAL(20,9)) >= 0.55 * count(*) AS sure FROM rf GROUP BY plan), pc AS (SELECT plan, count(*) AS c FROM ci GROUP BY plan), hd AS (SELECT *, greatest(1, least(r, c)) AS n FROM pl JOIN pc USING (plan)),
ck AS (SELECT plan, 20 * n AS w, r = c AS p FROM hd UNION ALL SELECT plan, 15 * n, ok % 3 <> 0 FROM hd UNION ALL SELECT plan, 15 * n, sure FROM hd
 UNION ALL SELECT plan, 10, abs(rf.dur - ci.dur) <= 0.05 FROM rf JOIN ci USING (plan, shot_idx) UNION ALL SELECT plan, 15, rf.motion = '' OR rf.motion = ci.motion FROM rf JOIN ci USING (plan, shot_idx)
 UNION ALL SELECT plan, 15, role = '' OR subj <> '' FROM rf JOIN ci USING (plan, shot_idx) UNION ALL SELECT plan, 20, pla >= subs FROM rf JOIN ci USING (plan, shot_idx) WHERE subs > 1)
SELECT plan, round(100 * sum(CASE WHEN p THEN w ELSE 0 END) / sum(w), 6) AS score FROM ck GROUP BY plan""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    m3 = F.col("l_partkey") % 3
    ref = ls.select("plan", "shot_idx", (F.col("l_quantity") / 10).alias("duration"), F.when(m3 == 0, "").when(m3 == 1, "pan").otherwise("tilt").alias("motion"),
                    F.when(F.col("l_partkey") % 4 == 0, "").otherwise("m").alias("role"), (F.col("l_suppkey") % 3).alias("subjects"), (F.col("l_discount") * 12).alias("confidence"))
    cine = ls.where("l_linenumber < 7 OR shot_idx = 0").select(
        "plan", "shot_idx", (F.col("l_quantity") / 10 + F.when(F.col("l_suppkey") % 5 == 0, 0.2).otherwise(0.0)).alias("duration"),
        F.when(F.col("l_suppkey") % 2 == 0, "pan").otherwise("tilt").alias("motion"), F.when(F.col("l_suppkey") % 7 == 0, "").otherwise("h").alias("subject"), (F.col("l_partkey") % 4).alias("placements"))
    plans = ls.select("plan", "l_orderkey").distinct().select("plan", F.lit(1.5).alias("ref_aspect"), F.when(F.col("l_orderkey") % 3 == 0, 1.8).otherwise(1.505).alias("cine_aspect"))
    return SC.weighted_checklist(ref, cine, plans, "plan", "shot_idx").withColumn("score", r6(F.col("score")))


SQL_STILL = "CASE WHEN i // 8 < label % 4 THEN sig[i+1] * 0.05 WHEN i % 8 >= 8 - label % 3 THEN 0.001 * sig[i+1] ELSE sig[i+1] END"


@query("a32_active_area", f"""WITH {B.FR}, px AS (SELECT label, i, stddev_pop(v) * 100 AS sd, avg(v) * 100 AS mean FROM (SELECT label, i, {SQL_STILL} AS v FROM fr, range(0, 64) r(i)) GROUP BY ALL),
ln_ AS (SELECT label, 'y' AS axis, i // 8 AS line, quantile_cont(sd, 0.9) AS sd, avg(mean) AS mean FROM px GROUP BY ALL UNION ALL SELECT label, 'x', i % 8, quantile_cont(sd, 0.9), avg(mean) FROM px GROUP BY ALL),
lv AS (SELECT label, min(line) FILTER (WHERE axis = 'x') AS x0, max(line) FILTER (WHERE axis = 'x') + 1 AS x1, min(line) FILTER (WHERE axis = 'y') AS y0, max(line) FILTER (WHERE axis = 'y') + 1 AS y1 FROM ln_ WHERE NOT (sd < 4 AND (mean < 60 OR sd < 2.5)) GROUP BY label),
k AS (SELECT *, y1 - y0 >= 2.4 AND x1 - x0 >= 2.4 AND NOT (y1 - y0 > 7.6 AND x1 - x0 > 7.6) AS keep FROM lv)
SELECT label, CASE WHEN keep THEN x0 END AS x0, CASE WHEN keep THEN y0 END AS y0, CASE WHEN keep THEN x1 END AS x1, CASE WHEN keep THEN y1 END AS y1 FROM k""")
def _(spark, sf):
    fr = B.frames(spark, sf).select("label", F.transform("sig", lambda v, i: F.when(F.floor(i / 8) < F.col("label") % 4, v * 0.05).when(
        i % 8 >= 8 - F.col("label") % 3, v * 0.001).otherwise(v)).alias("sig"))
    return SC.active_area(fr, ["label"], "sig", 8, 8, 100.0)


@query("a33_frame_difference", f"""WITH {B.FR}, p AS (SELECT clip, frame, sig, lag(sig) OVER (PARTITION BY clip ORDER BY frame) AS b FROM fr)
SELECT clip, frame, coalesce(round((SELECT avg(abs(sig[i+1] - b[i+1])) FROM range(0, 64) r(i) WHERE i // 8 BETWEEN 0 AND 6 AND i % 8 BETWEEN 0 AND 6), 6), 0.0) AS difference FROM p""")
def _(spark, sf):
    p = scale.previous(B.frames(spark, sf), ["clip"], "frame", {"b": "sig"})
    return p.select("clip", "frame", r6(SC.frame_difference(F.col("sig"), F.col("b"), 8, 8)).alias("difference"))


@query("a34_strongest_row", f"""WITH {B.FR}, px AS (SELECT vec_id, i // 8 AS y, abs(sig[i+1]) AS g, CASE WHEN abs(sig[64 - i]) > 0.12 THEN 0.0 ELSE 1.0 END AS m FROM fr, range(0, 64) r(i)),
rw AS (SELECT vec_id, y, sum(m) > 0.96 AS ok, CASE WHEN sum(m) > 0.96 THEN sum(g * m) / greatest(1.0, sum(m)) ELSE 0.0 END AS s FROM px GROUP BY ALL)
SELECT vec_id, CASE WHEN max(s) > 0 THEN arg_max(y, {{'s': s, 'y': -y}}) END AS "row", CASE WHEN max(s) > 0 THEN round(max(s) / (median(s) FILTER (WHERE ok) + 1e-6), 5) END AS contrast FROM rw GROUP BY vec_id""")
def _(spark, sf):
    fr = B.frames(spark, sf).select("vec_id", F.transform("sig", F.abs).alias("g"),
                                    F.transform(F.reverse("sig"), lambda v: F.when(F.abs(v) > 0.12, 0.0).otherwise(1.0)).alias("m"))
    out = SC.strongest_row(fr, ["vec_id"], "g", "m", 8, 8)
    return out.select("vec_id", F.col("row").cast("bigint").alias("row"), F.round("contrast", 5).alias("contrast"))


@query("a35_band_median_point", f"""WITH {B.FR}, bn AS (SELECT vec_id, sig[3*j+1] * 60 AS x, sig[3*j+2] * 60 AS y, j * 9.0 + sig[3*j+3] * 40 AS z FROM fr, range(0, 21) r(j)), bd AS (SELECT vec_id, 0.0 AS cx, 0.0 AS cy, 180.0 AS tall, (vec_id % 11) / 10 AS ratio FROM fr),
n AS (SELECT bn.vec_id, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys FROM bn JOIN bd USING (vec_id) WHERE abs(z - 180 * ratio) <= 10.8 AND sqrt(x*x + y*y) <= 27 GROUP BY bn.vec_id)
SELECT bd.vec_id, round(CASE WHEN len(xs) >= 2 THEN xs[len(xs) // 2 + 1] ELSE cx END, 6) AS x, round(CASE WHEN len(ys) >= 2 THEN ys[len(ys) // 2 + 1] ELSE cy END, 6) AS y, round(180.0 * ratio, 6) AS z FROM bd LEFT JOIN n USING (vec_id)""")
def _(spark, sf):
    fr = B.frames(spark, sf)
    pts = F.array(*[F.struct((F.get("sig", F.lit(3 * j)) * 60).alias("x"), (F.get("sig", F.lit(3 * j + 1)) * 60).alias("y"),
                             (j * 9.0 + F.get("sig", F.lit(3 * j + 2)) * 40).alias("z")) for j in range(21)])
    bones = fr.select("vec_id", F.inline(pts))
    bodies = fr.select("vec_id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("z0"), F.lit(180.0).alias("z1"), ((F.col("vec_id") % 11) / 10).alias("ratio"))
    out = SC.band_median_point(bones, bodies, "vec_id")
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in "xyz"])
