"""Motion and detection metrics over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import keypoints as K
from framewise.operators import metrics as M
from framewise.plans import bindings as B
from framewise.plans.q_functions import SQL_USABLE, r6, sql_angle
from framewise.plans.registry import query, table
from framewise.staging import stage

FINGERS = [("LeftIndex1", "LeftIndex2"), ("RightThumb1", "RightThumb2")]


def sql_segments(segments) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(segments)) + ") g(a, b, ord)"


def sql_seg_angles(name: str, segments) -> str:
    u, v = [f"u{c}" for c in "xyz"], [f"v{c}" for c in "xyz"]
    return f"""{name}_d AS (SELECT p.pair, p.side, p.sample, g.a || '->' || g.b AS segment, g.ord, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz
 FROM po p JOIN {sql_segments(segments)} ON p.role = g.a JOIN po q ON q.pair = p.pair AND q.side = p.side AND q.sample = p.sample AND q.role = g.b),
{name} AS (SELECT pair, sample, segment, ord, deg FROM (SELECT pair, sample, segment, ord, {sql_angle(u, v)} AS deg FROM (SELECT s.pair, s.sample, s.segment, s.ord, s.dx ux, s.dy uy, s.dz uz, t.dx vx, t.dy vy, t.dz vz
 FROM {name}_d s JOIN {name}_d t ON s.side = 's' AND t.side = 't' AND s.pair = t.pair AND s.sample = t.sample AND s.segment = t.segment)) WHERE deg IS NOT NULL),
{name}_s AS (SELECT pair, segment, ord, m AS median_deg, median(abs(deg - m)) AS mad_deg FROM (SELECT *, median(deg) OVER (PARTITION BY pair, segment) AS m FROM {name}) GROUP BY pair, segment, ord, m)"""


SQL_BODY = B.PO + ", " + sql_seg_angles("sa", C.SEGMENTS)
SQL_SCALE = """c0 AS (SELECT pair, side, role, x, y, z, list_position(['Pelvis', 'LeftThigh', 'LeftCalf', 'LeftFoot'], role) AS k FROM po WHERE sample = 0 AND role IN ('Pelvis', 'LeftThigh', 'LeftCalf', 'LeftFoot')),
sc AS (SELECT e.pair, e.side, coalesce(CASE WHEN n = 4 THEN total END, 0.0) AS scale FROM (SELECT DISTINCT pair, side FROM po) e LEFT JOIN
 (SELECT pair, side, count(*) AS n, sum(sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2)) AS total FROM (SELECT *, lag(x) OVER w px, lag(y) OVER w py, lag(z) OVER w pz FROM c0 WINDOW w AS (PARTITION BY pair, side ORDER BY k)) GROUP BY ALL) t USING (pair, side))"""
SQL_GROUND = SQL_SCALE + """, gr AS (SELECT pair, side, role, sample, x, y, z, scale, min(z) OVER (PARTITION BY pair, side, role) AS lowest FROM po JOIN sc USING (pair, side) WHERE role IN ('LeftFoot', 'RightFoot') AND scale > 1e-6)"""
SQL_CONTACT = """hh AS (SELECT pair, side, role, sample, (z - min(z) OVER (PARTITION BY pair, side)) / scale AS h FROM gr),
ct AS (SELECT s.pair, median(abs(s.h - t.h)) AS foot_clearance_error, avg(CASE WHEN (s.h <= 0.08) <> (t.h <= 0.08) THEN 1.0 ELSE 0.0 END) AS contact_mismatch
 FROM hh s JOIN hh t ON s.side = 's' AND t.side = 't' AND s.pair = t.pair AND s.role = t.role AND s.sample = t.sample GROUP BY s.pair)"""
SQL_TWIST = """tr AS (SELECT pair, side, role, max(degrees(2 * acos(least(1.0, abs(q0[1]*q[1] + q0[2]*q[2] + q0[3]*q[3] + q0[4]*q[4]))))) AS deg FROM (SELECT *, first_value(q) OVER w AS q0, row_number() OVER w AS rn FROM tw WINDOW w AS (PARTITION BY pair, side, role ORDER BY sample)) WHERE rn > 1 GROUP BY ALL),
tt AS (SELECT s.pair, count(*) AS twist_compared, count(*) FILTER (WHERE s.deg >= 5 AND t.deg < 0.2 * s.deg) AS twist_dropped, coalesce(max(CASE WHEN s.deg >= 5 THEN abs(t.deg / s.deg - 1) END), 0.0) AS twist_ratio_error
 FROM tr s JOIN tr t ON s.side = 's' AND t.side = 't' AND s.pair = t.pair AND s.role = t.role GROUP BY s.pair)"""


@query("j7_role_segment_join", f"WITH {SQL_BODY} SELECT pair, sample, segment, round(deg, 5) AS deg FROM sa")
def _(spark, sf):
    return M.segment_angles(B.poses(spark, sf), C.SEGMENTS).withColumn("deg", F.round("deg", 5))


@query("a12_pose_scale", f"WITH {B.PO}, {SQL_SCALE} SELECT pair, side, round(scale, 6) AS scale FROM sc")
def _(spark, sf):
    return M.pose_scale(B.poses(spark, sf)).withColumn("scale", r6(F.col("scale")))


@query("a13_segment_error", f"""WITH {SQL_BODY}, ov AS (SELECT pair, median(deg) AS m, quantile_cont(deg, 0.9) AS p FROM sa GROUP BY pair),
wo AS (SELECT pair, arg_max(segment, {{'m': median_deg, 'o': -ord}}) AS worst_segment, max(median_deg) AS w, max(mad_deg) AS d, count(*) AS n FROM sa_s GROUP BY pair)
SELECT pair, worst_segment, round(w, 5) AS worst_segment_deg, round(d, 5) AS motion_deviation_deg, n AS segments_compared, round(m, 5) AS median_deg, round(p, 5) AS p90_deg FROM wo JOIN ov USING (pair)""")
def _(spark, sf):
    e = M.pair_error(M.segment_angles(B.poses(spark, sf), C.SEGMENTS), C.SEGMENTS)
    return e.select("pair", "worst_segment", "segments_compared", *[F.round(c, 5).alias(c) for c in (
        "worst_segment_deg", "motion_deviation_deg", "median_deg", "p90_deg")])


@query("a14_contact_metrics", f"WITH {B.PO}, {SQL_GROUND}, {SQL_CONTACT} SELECT pair, round(foot_clearance_error, 6) AS foot_clearance_error, round(contact_mismatch, 6) AS contact_mismatch FROM ct")
def _(spark, sf):
    return M.contact_metrics(B.poses(spark, sf)).select("pair", *[r6(F.col(c)).alias(c) for c in ("foot_clearance_error", "contact_mismatch")])


@query("a15_foot_slide", f"""WITH {B.PO}, {SQL_GROUND}, mv AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM gr WINDOW w AS (PARTITION BY pair, side, role ORDER BY sample))
SELECT pair, side, round(median(sqrt((x-px)**2 + (y-py)**2) / scale), 6) AS foot_slide FROM mv WHERE pz IS NOT NULL AND z <= lowest + scale * 0.08 AND pz <= lowest + scale * 0.08 GROUP BY ALL""")
def _(spark, sf):
    return M.foot_slide(B.poses(spark, sf)).withColumn("foot_slide", r6(F.col("foot_slide")))


@query("a16_twist_transfer", f"WITH {B.TW}, {SQL_TWIST} SELECT pair, twist_compared, twist_dropped, round(twist_ratio_error, 5) AS twist_ratio_error FROM tt")
def _(spark, sf):
    return M.twist_transfer(B.twists(spark, sf)).withColumn("twist_ratio_error", F.round("twist_ratio_error", 5))


SQL_QUALITY = f"""{SQL_BODY}, {sql_seg_angles('sf', FINGERS)}, {SQL_GROUND}, {SQL_CONTACT}, {'tw AS' + B.TW.split(', tw AS', 1)[1]}, {SQL_TWIST},
qr AS (SELECT e.pair, w.w AS worst_segment_deg, w.d AS motion_deviation_deg, w.n AS segments_compared, w.worst_segment, f.w AS finger_worst_deg, f.m AS finger_median_deg, m.m AS median_deg, ct.foot_clearance_error, ct.contact_mismatch, tt.twist_dropped, tt.twist_ratio_error
 FROM (SELECT DISTINCT pair FROM po) e LEFT JOIN (SELECT pair, max(median_deg) AS w, max(mad_deg) AS d, count(*) AS n, arg_max(segment, {{'m': median_deg, 'o': -ord}}) AS worst_segment FROM sa_s GROUP BY pair) w USING (pair)
 LEFT JOIN (SELECT pair, max(median_deg) AS w, median(median_deg) AS m FROM sf_s GROUP BY pair) f USING (pair) LEFT JOIN (SELECT pair, median(deg) AS m FROM sa GROUP BY pair) m USING (pair) LEFT JOIN ct USING (pair) LEFT JOIN tt USING (pair)),
qf AS (SELECT *, list_filter([CASE WHEN worst_segment_deg > 100 THEN 'worst_segment' END, CASE WHEN motion_deviation_deg > 30 THEN 'motion_deviation' END, CASE WHEN foot_clearance_error > 0.3 THEN 'foot_clearance' END,
 CASE WHEN contact_mismatch > 0.15 THEN 'contact' END, CASE WHEN finger_worst_deg > 95 THEN 'finger' END, CASE WHEN twist_dropped > 0 THEN 'twist_dropped' END, CASE WHEN twist_dropped = 0 AND twist_ratio_error > 0.05 THEN 'twist_ratio' END], lambda x: x IS NOT NULL) AS reasons FROM qr)"""
LIMITS = {"worst_segment_deg": 100.0, "motion_deviation_deg": 30.0, "foot_clearance_error": 0.3, "contact_mismatch": 0.15,
          "finger_worst_deg": 95.0, "twist_ratio_error": 0.05}


def quality(spark, sf):
    rows = M.quality_rows(stage(B.poses(spark, sf), "poses"), B.twists(spark, sf), C.SEGMENTS, FINGERS)
    return M.quality_flags(rows, LIMITS)


@query("a17_quality_flags", f"WITH {SQL_QUALITY} SELECT pair, coalesce(segments_compared, 0) > 0 AS measured, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS needs_review FROM qf")
def _(spark, sf):
    return quality(spark, sf).select("pair", "measured", F.array_join("reasons", ",").alias("reasons"), "needs_review")


SQL_ROWS = """rw AS (SELECT l_returnflag, l_linestatus, l_orderkey * 8 + l_linenumber AS ord, l_extendedprice / 1000 AS median_deg, l_quantity * 3 AS worst_segment_deg, 'seg_' || l_linenumber AS worst_segment,
 CASE WHEN l_tax > 0 THEN l_discount END AS foot_clearance_error, l_tax AS contact_mismatch, l_quantity / 7 AS motion_deviation_deg, CASE WHEN l_linenumber > 2 THEN l_extendedprice / 2000 END AS finger_median_deg FROM lineitem)"""
SQL_SUMMARY = """count(*) AS pairs, round(median(median_deg), 6) AS segment_angle_median_deg, max(worst_segment_deg) AS worst_segment_deg, max(foot_clearance_error) AS foot_clearance_worst, max(contact_mismatch) AS contact_mismatch_worst,
 round(max(motion_deviation_deg), 6) AS motion_deviation_worst_deg, round(median(finger_median_deg), 6) AS finger_angle_median_deg, count(finger_median_deg) AS pairs_with_fingers, arg_max(worst_segment, {'w': worst_segment_deg, 'o': -ord}) AS worst_segment"""


def summary_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), (F.col("l_extendedprice") / 1000).alias("median_deg"),
        (F.col("l_quantity") * 3).alias("worst_segment_deg"), F.concat(F.lit("seg_"), "l_linenumber").alias("worst_segment"),
        F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("foot_clearance_error"), F.col("l_tax").alias("contact_mismatch"),
        (F.col("l_quantity") / 7).alias("motion_deviation_deg"), F.when(F.col("l_linenumber") > 2, F.col("l_extendedprice") / 2000).alias("finger_median_deg"))


def rounded_summary(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("segment_angle_median_deg", "motion_deviation_worst_deg", "finger_angle_median_deg")})


@query("a18_group_summary", f"WITH {SQL_ROWS} SELECT l_returnflag, l_linestatus, {SQL_SUMMARY} FROM rw GROUP BY ALL")
def _(spark, sf):
    return rounded_summary(M.group_summary(summary_rows(spark, sf), ["l_returnflag", "l_linestatus"]))


@query("a19_suite_summary", f"WITH {SQL_ROWS} SELECT {SQL_SUMMARY} FROM rw")
def _(spark, sf):
    return rounded_summary(M.group_summary(summary_rows(spark, sf), []))


@query("a1_robust_stats", """WITH m AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, median(l_extendedprice) OVER w AS med FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, round(med, 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(median(abs(x - med)), 6) AS mad, round(1.4826 * median(abs(x - med)), 6) AS spread, round(max(abs(x - med)), 6) AS max_deviation, count(*) AS n
FROM m GROUP BY l_returnflag, l_linestatus, med""")
def _(spark, sf):
    s = M.robust_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return s.select("l_returnflag", "l_linestatus", "n", *[r6(F.col(c)).alias(c) for c in ("median", "p90", "mad", "spread", "max_deviation")])


DAY = "floor(t / 86400)"


@query("a2_estimate_fusion", f"""WITH {B.EV}, e AS (SELECT reel, floor(t / 86400)::BIGINT AS day, event_type = 'click' AS vert, ln(1 + value) / 2 AS l, 1.0 / ((0.1 + k / 100.0) * (0.1 + k / 100.0)) AS w FROM ev),
v AS (SELECT *, max(CASE WHEN vert THEN l END) OVER (PARTITION BY reel, day) AS vl FROM e), u AS (SELECT * FROM v WHERE vert OR vl IS NULL OR l >= vl - 0.35), c AS (SELECT *, median(l) OVER (PARTITION BY reel, day) AS med FROM u),
k AS (SELECT *, abs(l - med) <= 0.3 AS near, max(CASE WHEN abs(l - med) <= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY reel, day) AS any_near FROM c)
SELECT reel, day, round(exp(sum(w * l) / sum(w)), 6) AS height, count(*)::INT AS n_kept FROM k WHERE near OR any_near = 0 GROUP BY ALL""")
def _(spark, sf):
    ev = B.event_series(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    sigma = 0.1 + F.col("k") / 100.0
    e = ev.select(
        "reel", "day", F.when(F.col("event_type") == "click", "vertical").otherwise(F.col("event_type")).alias("kind"),
        (F.log1p("value") / 2).alias("log_h"), (1.0 / (sigma * sigma)).alias("weight"))
    return M.estimate_fusion(e, ["reel", "day"]).withColumn("height", r6(F.col("height")))


@query("a3_line_fit_single_pass", f"""WITH {B.KP}, p AS (SELECT vec_id, unnest(list_transform([{', '.join(str(j) for j in C.KEYPOINT_RATIO)}], lambda j: {{'w': kp[j+1].score, 'x': kp[j+1].x, 'y': kp[j+1].y, 'r': ([{', '.join(str(v) for v in C.KEYPOINT_RATIO.values())}])[list_position([{', '.join(str(j) for j in C.KEYPOINT_RATIO)}], j)]::DOUBLE}})) AS s FROM kp),
q AS (SELECT vec_id, s.w AS w, s.x AS x, s.y AS y, s.r AS r FROM p WHERE s.w >= 0.35),
g AS (SELECT vec_id, count(*) AS n, max(r) - min(r) AS span, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*r)/sum(w) AS mr, sum(w*r*r)/sum(w) AS mrr, sum(w*r*x)/sum(w) AS mrx, sum(w*r*y)/sum(w) AS mry FROM q GROUP BY vec_id)
SELECT vec_id, n, round((mrx - mr*mx) / (mrr - mr*mr), 4) AS bx, round((mry - mr*my) / (mrr - mr*mr), 4) AS by FROM g WHERE n >= 2 AND span >= 0.1""".replace(" AS by FROM g", ' AS "by" FROM g'))
def _(spark, sf):
    kp = B.keypoints(spark, sf)
    rows = F.array(*[F.struct(F.lit(r).alias("ratio"), F.get("kp", F.lit(j)).alias("p")) for j, r in C.KEYPOINT_RATIO.items()])
    pts = kp.select("vec_id", F.inline(rows)).select("vec_id", "ratio", "p.x", "p.y", "p.score").where("score >= 0.35")
    return M.line_fit(pts, ["vec_id"]).select("vec_id", "n", F.round("bx", 4).alias("bx"), F.round("by", 4).alias("by"))


def sql_mean(i, j, a):
    return f"CASE WHEN list_contains(u, {i}) AND list_contains(u, {j}) THEN (kp[{i+1}].{a} + kp[{j+1}].{a}) / 2 WHEN list_contains(u, {i}) THEN kp[{i+1}].{a} WHEN list_contains(u, {j}) THEN kp[{j+1}].{a} END"


@query("a5_calibrate_ratios", f"""WITH {B.KP}, u AS (SELECT label, kp, {SQL_USABLE.format(t=0.3)} AS u FROM kp),
h AS (SELECT *, {sql_mean(11, 12, 'y')} AS hy, {sql_mean(15, 16, 'y')} AS fy, {sql_mean(11, 12, 'x')} AS hx, {sql_mean(15, 16, 'x')} AS fx FROM u),
o AS (SELECT *, (fy - hy) / (0.53 - 0.045) AS unit FROM h WHERE fy - hy >= 30 AND abs(fx - hx) <= 0.35 * (fy - hy)),
im AS (SELECT label, j::VARCHAR AS name, 0.53 + (hy - kp[j+1].y) / unit AS v FROM o, range(0, 7) r(j) WHERE list_contains(u, j)
 UNION ALL SELECT label, 'shoulder_width', sqrt((kp[6].x-kp[7].x)**2 + (kp[6].y-kp[7].y)**2) / unit FROM o WHERE unit >= 72 AND list_contains(u, 5) AND list_contains(u, 6)
 UNION ALL SELECT label, 'ear_width', sqrt((kp[4].x-kp[5].x)**2 + (kp[4].y-kp[5].y)**2) / unit FROM o WHERE unit >= 72 AND list_contains(u, 3) AND list_contains(u, 4)),
g AS (SELECT label, name, count(*) AS n, median(v) AS m, CASE name WHEN 'shoulder_width' THEN 0.21 WHEN 'ear_width' THEN 0.085 WHEN '0' THEN 0.925 WHEN '1' THEN 0.94 WHEN '2' THEN 0.94 WHEN '3' THEN 0.935 WHEN '4' THEN 0.935 ELSE 0.83 END::DOUBLE AS d FROM im GROUP BY ALL HAVING count(*) >= 2)
SELECT label, name, round(CASE WHEN name LIKE '%width' THEN greatest(d * 0.75, least(d * 2.0, m)) ELSE greatest(d - 0.06, least(d + 0.06, m)) END, 6) AS ratio, n FROM g""")
def _(spark, sf):
    kp = B.keypoints(spark, sf)
    out = M.calibrate_ratios(kp, "label", K.usable_keypoints(F.col("kp"), 0.3, 1280, 720), 144.0, 2)
    return out.withColumn("ratio", r6(F.col("ratio")))


@query("a6_shot_summary", f"""WITH {B.EV}, s AS (SELECT reel, floor(t / 86400)::BIGINT AS day, i, event_type <> 'error' AS det, value / 40 AS h, k / 100.0 AS fx, (value % 10) / 10 AS fy, k / 200.0 AS bw, 0.3 + k / 150.0 AS sc, 1 + k % 3 AS people FROM ev),
sh AS (SELECT reel, day, CASE WHEN (reel + day) % 3 = 0 THEN 'pan' ELSE 'static' END AS motion FROM s GROUP BY ALL),
g AS (SELECT reel, day, count(*) AS n, count(*) FILTER (WHERE det) AS f, max(people) AS pm, median(h) FILTER (WHERE det) AS mh, median(fx) FILTER (WHERE det) AS mx, median(fy) FILTER (WHERE det) AS my, median(bw) FILTER (WHERE det) AS mb,
 avg(sc) FILTER (WHERE det) AS q, stddev_pop(h) FILTER (WHERE det) AS sd, avg(h) FILTER (WHERE det) AS me, stddev_pop(fx) FILTER (WHERE det) AS sx FROM s GROUP BY ALL)
SELECT reel, day, round(mh, 6) AS height, round(CASE WHEN f = 0 THEN 0.5 ELSE mx END, 6) AS focus_x, round(CASE WHEN f = 0 THEN 0.5 ELSE my END, 6) AS focus_y, round(CASE WHEN f = 0 THEN 0.3 ELSE mb END, 6) AS box_width, f AS found,
 round(CASE WHEN f = 0 THEN 0.1 ELSE greatest(0.0, least(1.0, 0.15 + 0.85 * least(1.0, q) * (f / n) * greatest(0.0, CASE WHEN motion = 'static' AND f >= 2 THEN 1.0 - 0.5 * least(1.0, sd / greatest(1e-6, me) * 4) - 0.3 * least(1.0, sx * 8) ELSE 1.0 END))) END, 6) AS confidence,
 CASE WHEN f = 0 THEN 0 ELSE pm END AS people_max FROM g JOIN sh USING (reel, day)""")
def _(spark, sf):
    ev = B.event_series(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    s = ev.select("reel", "day", (F.col("event_type") != "error").alias("detected"), (F.col("value") / 40).alias("height"), (F.col("k") / 100.0).alias("focus_x"),
                  ((F.col("value") % 10) / 10).alias("focus_y"), (F.col("k") / 200.0).alias("box_width"), (0.3 + F.col("k") / 150.0).alias("score"), (1 + F.col("k") % 3).alias("people"))
    shots = s.select("reel", "day", F.when((F.col("reel") + F.col("day")) % 3 == 0, "pan").otherwise("static").alias("motion")).distinct()
    out = M.shot_summary(s, shots, ["reel", "day"])
    return out.withColumns({c: r6(F.col(c)) for c in ("height", "focus_x", "focus_y", "box_width", "confidence")})


SQL_MOTION = B.EV + f""", pr AS (SELECT reel, floor(t / 432000)::BIGINT AS shot, i, 1 + (k - 50) / 2000.0 AS scale, CASE WHEN reel % 3 = 0 THEN k / 1500.0 ELSE (value - 40) / 3000 END AS tx, (k - 50) / 5000.0 AS ty, 100 + value * CASE WHEN reel % 2 = 0 THEN 0.2 ELSE 3 END AS height, 50 + value AS box, k / 100.0 AS x, event_type FROM ev),
n1 AS (SELECT *, row_number() OVER (PARTITION BY reel, shot ORDER BY i) - 1 AS o, lag(tx) OVER (PARTITION BY reel, shot ORDER BY i) AS ptx, lag(ty) OVER (PARTITION BY reel, shot ORDER BY i) AS pty FROM pr),
mv AS (SELECT reel, shot, count(*) AS pairs, exp(sum(ln(scale))) AS net_scale, sum(tx) AS net_tx, sum(ty) AS net_ty, sum(sqrt(tx*tx + ty*ty)) AS path,
 count(*) FILTER (WHERE tx*ptx < 0 AND abs(tx) > 0.004 AND abs(ptx) > 0.004) + count(*) FILTER (WHERE ty*pty < 0 AND abs(ty) > 0.004 AND abs(pty) > 0.004) AS direction_changes FROM n1 GROUP BY ALL),
su AS (SELECT *, row_number() OVER (PARTITION BY reel, shot ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY reel, shot) AS n FROM n1 WHERE event_type <> 'error'),
sz AS (SELECT reel, shot, any_value(n) AS n, median(height) FILTER (WHERE r >= n - n // 2) / median(height) FILTER (WHERE r < n // 2) AS ss, median(box) FILTER (WHERE r >= n - n // 2) / median(box) FILTER (WHERE r < n // 2) AS bs,
 exp(regr_slope(ln(height), r / (n - 1))) AS sf, arg_max(x, r) - arg_min(x, r) AS dx FROM su GROUP BY ALL),
ft AS (SELECT mv.*, CASE WHEN n >= 3 THEN ss END AS subject_scale, CASE WHEN n >= 3 THEN bs END AS box_scale, CASE WHEN n >= 3 THEN sf END AS subject_scale_full, CASE WHEN n >= 2 THEN dx END AS subject_dx FROM mv LEFT JOIN sz USING (reel, shot)),
lb AS (SELECT *, CASE WHEN pairs >= 3 AND path > 0.05 AND abs(ln(greatest(net_scale, 1e-6))) < 0.06 AND (direction_changes >= 3 OR sqrt(net_tx*net_tx + net_ty*net_ty) < path * 0.5) THEN 'handheld'
 WHEN pairs >= 4 AND direction_changes >= 5 AND path > 0.3 THEN 'handheld' WHEN subject_scale > 1.08 AND box_scale > 1.04 AND subject_scale > net_scale * 1.06 THEN 'dolly_in'
 WHEN subject_scale < 0.92 AND box_scale < 0.96 AND subject_scale < net_scale / 1.06 THEN 'dolly_out' WHEN net_scale > 1.06 THEN 'zoom_in' WHEN net_scale < 0.94 THEN 'zoom_out'
 WHEN abs(net_tx) > 0.06 OR abs(net_ty) > 0.06 THEN CASE WHEN abs(subject_dx) < 0.04 AND abs(net_tx) > 0.06 THEN 'tracking' WHEN abs(net_tx) >= abs(net_ty) THEN 'pan' ELSE 'tilt' END ELSE 'static' END AS motion FROM ft)"""


def motion_inputs(spark, sf):
    from pyspark.sql import Window
    ev = B.event_series(spark, sf)
    user = F.col("reel")
    w = Window.partitionBy("reel", "shot").orderBy("e")
    pr = ev.select("reel", F.floor(F.col("t") / 432000).alias("shot"), F.col("i").alias("e"), (1 + (F.col("k") - 50) / 2000.0).alias("scale"),
                   F.when(user % 3 == 0, F.col("k") / 1500.0).otherwise((F.col("value") - 40) / 3000).alias("tx"), ((F.col("k") - 50) / 5000.0).alias("ty"),
                   (100 + F.col("value") * F.when(user % 2 == 0, 0.2).otherwise(3)).alias("height"), (50 + F.col("value")).alias("box"),
                   (F.col("k") / 100.0).alias("x"), "event_type").withColumn("i", (F.row_number().over(w) - 1).cast("bigint"))
    return pr.select("reel", "shot", "i", "scale", "tx", "ty"), pr.where("event_type <> 'error'").select("reel", "shot", "i", "height", "box", "x")


FEATS = ["net_scale", "net_tx", "net_ty", "path", "subject_scale", "box_scale", "subject_scale_full", "subject_dx"]


@query("a7_motion_features", f"WITH {SQL_MOTION} SELECT reel, shot, pairs, direction_changes, {', '.join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM ft")
def _(spark, sf):
    f = M.motion_features(*motion_inputs(spark, sf), ["reel", "shot"])
    return f.select("reel", "shot", "pairs", "direction_changes", *[r6(F.col(c)).alias(c) for c in FEATS])


@query("a8_classify_motion", f"WITH {SQL_MOTION} SELECT reel, shot, motion FROM lb")
def _(spark, sf):
    return M.classify_motion(M.motion_features(*motion_inputs(spark, sf), ["reel", "shot"])).select("reel", "shot", "motion")


@query("a9_motion_amount", f"""WITH {SQL_MOTION} SELECT reel, shot, motion, CASE WHEN motion <> 'static' THEN round(net_tx, 6) END AS screen_dx, CASE WHEN motion <> 'static' THEN pairs END AS steps,
 CASE WHEN motion <> 'static' THEN round(coalesce(subject_scale_full, subject_scale), 6) END AS subject_scale FROM lb""")
def _(spark, sf):
    a = M.motion_amount(M.classify_motion(M.motion_features(*motion_inputs(spark, sf), ["reel", "shot"])))
    return a.select("reel", "shot", "motion", F.round("amount.screen_dx", 6).alias("screen_dx"), F.col("amount.steps").alias("steps"),
                    F.round("amount.subject_scale", 6).alias("subject_scale"))


@query("a10_camera_angle_vote", f"""WITH {B.EV}, s AS (SELECT reel, floor(t / 86400)::BIGINT AS day, k % 7 = 0 AS tilted, CASE WHEN event_type IN ('click', 'view') THEN (k - 30) / 90.0 END AS nose, CASE WHEN event_type = 'error' THEN k / 80.0 END AS horizon, CASE WHEN event_type = 'signup' THEN value / 200 END AS head FROM ev),
g AS (SELECT reel, day, median(nose) FILTER (WHERE NOT tilted) AS nose, median(horizon) FILTER (WHERE NOT tilted) AS horizon, median(head) FILTER (WHERE NOT tilted) AS head FROM s GROUP BY ALL),
v AS (SELECT reel, day, CASE WHEN nose < -0.15 THEN {{'a': 'overhead', 'c': 0.7}} WHEN horizon < 0.72 * 0.8 - 0.15 THEN {{'a': 'low', 'c': 0.75}} WHEN horizon > 0.9 THEN {{'a': 'high', 'c': 0.75}} WHEN horizon IS NOT NULL THEN {{'a': 'eye', 'c': 0.75}}
 WHEN nose > 0.37 THEN {{'a': 'low', 'c': 0.45}} WHEN nose < 0.2 THEN {{'a': 'high', 'c': 0.45}} WHEN nose IS NOT NULL THEN {{'a': 'eye', 'c': 0.45}} WHEN head > 0.25 THEN {{'a': 'overhead', 'c': 0.5}} ELSE {{'a': 'eye', 'c': 0.3}} END AS v FROM g)
SELECT reel, day, v.a AS angle, v.c::DOUBLE AS confidence FROM v""")
def _(spark, sf):
    ev = B.event_series(spark, sf)
    s = ev.select("reel", F.floor(F.col("t") / 86400).alias("day"), (F.col("k") % 7 == 0).alias("tilted"),
                  F.when(F.col("event_type").isin("click", "view"), (F.col("k") - 30) / 90.0).alias("nose"),
                  F.when(F.col("event_type") == "error", F.col("k") / 80.0).alias("horizon"),
                  F.when(F.col("event_type") == "signup", F.col("value") / 200).alias("head"), F.lit(0.72).alias("focus_ratio"))
    return M.camera_angle_vote(s, ["reel", "day"])


@query("a11_side_majority", f"""WITH {B.LS}, c AS (SELECT plan, l_linenumber AS sample, shot_idx, CASE WHEN l_returnflag = 'A' THEN 'left' WHEN l_returnflag = 'R' THEN 'right' ELSE 'left' END AS side, l_discount AS x0, l_discount + l_tax AS x1, l_quantity / 50 AS h, l_extendedprice AS area, l_tax * 10 AS p FROM ls WHERE l_linestatus = 'O'),
d AS (SELECT plan, count(DISTINCT l_linenumber) AS nd FROM ls GROUP BY plan), p AS (SELECT plan, sample, arg_max({{'side': side, 'x0': x0, 'x1': x1, 'h': h, 'p': p}}, {{'a': area, 'i': -shot_idx}}) AS c FROM c GROUP BY ALL),
v AS (SELECT plan, CASE WHEN count(*) FILTER (WHERE c.side = 'left') >= count(*) FILTER (WHERE c.side = 'right') THEN 'left' ELSE 'right' END AS side FROM p GROUP BY plan)
SELECT v.plan, v.side, count(*) AS n, round(median((c.x0 + c.x1) / 2), 6) AS screen_x, round(median(c.x1 - c.x0), 6) AS screen_width, round(median(c.h), 6) AS screen_height, round(least(1.0, count(*) / any_value(nd)) * avg(c.p), 6) AS confidence
FROM v JOIN p ON p.plan = v.plan AND p.c.side = v.side JOIN d ON d.plan = v.plan GROUP BY v.plan, v.side HAVING count(*) * 2 >= any_value(nd)""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    cand = ls.where("l_linestatus = 'O'").select("plan", F.col("l_linenumber").alias("sample"), F.col("shot_idx").alias("ord"),
        F.when(F.col("l_returnflag") == "R", "right").otherwise("left").alias("side"), F.col("l_discount").alias("x0"), (F.col("l_discount") + F.col("l_tax")).alias("x1"),
        (F.col("l_quantity") / 50).alias("height"), F.col("l_extendedprice").alias("area"), (F.col("l_tax") * 10).alias("probability"))
    out = M.side_majority(cand, ls.groupBy("plan").agg(F.countDistinct("l_linenumber").alias("n_detected")), ["plan"], "sample")
    return out.withColumns({c: r6(F.col(c)) for c in ("screen_x", "screen_width", "screen_height", "confidence")})


MOVERS = ["LeftHand", "RightHand", "LeftFoot", "RightFoot"]


@query("a28_motion_range", f"""WITH {B.PO}, e AS (SELECT pair, max(greatest(ex, ey, ez)) AS extent FROM (SELECT pair, role, max(x)-min(x) AS ex, max(y)-min(y) AS ey, max(z)-min(z) AS ez, count(*) AS n FROM po WHERE side = 's' AND role IN {tuple(MOVERS)} GROUP BY ALL) WHERE n > 1 GROUP BY pair),
st AS (SELECT pair, greatest(abs(x - lag(x) OVER w), abs(y - lag(y) OVER w), abs(z - lag(z) OVER w)) AS s, lag(x) OVER w AS px FROM po WHERE side = 's' AND role IN {tuple(MOVERS)} WINDOW w AS (PARTITION BY pair, role ORDER BY sample)),
m AS (SELECT pair, list_sort(list(s)) AS a FROM st WHERE px IS NOT NULL GROUP BY pair) SELECT pair, round(extent, 6) AS extent, round(a[len(a) // 2 + 1], 6) AS step FROM e JOIN m USING (pair)""")
def _(spark, sf):
    src = B.poses(spark, sf).where("side = 's'")
    return M.motion_extent(src, ["pair"], MOVERS).join(M.step_median(src, ["pair"], MOVERS), "pair").select(
        "pair", r6(F.col("extent")).alias("extent"), r6(F.col("step")).alias("step"))


@query("a29_active_curves", """WITH r AS (SELECT user_id, event_type, max(value) - min(value) AS rng FROM events GROUP BY ALL HAVING max(value) - min(value) > 0.01)
SELECT user_id, event_type, rng AS range, (SELECT count(*) FROM r) AS moving FROM r ORDER BY rng DESC, user_id, event_type LIMIT 12""")
def _(spark, sf):
    return M.active_curves(table(spark, sf, "events"), ["user_id", "event_type"])


RULES = [("A", "F.count", "min", 100.0), ("A", "O.avg_qty", "max", 25.6), ("N", "F.count", "equals", 0.0), ("N", "O.max_price", "max", 1.0), ("R", "X.count", "min", 1.0),
         ("R", "F.avg_qty", "min", 25.0), ("B", "F.count", "min", 1.0), ("S", "deep.F.count", "min", 1.0)]
SKIPS = [("S", "deep")]
ERRORS = ["B"]


@query("j18_rule_join", f"""WITH m AS (SELECT l_returnflag AS suite, l_linestatus || '.' || name AS path, round(v, 6) AS value FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS count, avg(l_quantity) AS avg_qty, max(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL) UNPIVOT (v FOR name IN (count, avg_qty, max_price))),
r AS (SELECT * FROM (VALUES {', '.join(repr(r) for r in RULES)}) t(suite, path, op, bound)), s AS (SELECT * FROM (VALUES ('S', 'deep')) t(suite, path)), e AS (SELECT 'B' AS suite)
SELECT r.suite, r.path, r.op, m.value, CASE WHEN r.suite IN (SELECT suite FROM e) THEN 'FAIL' WHEN EXISTS (SELECT 1 FROM s WHERE s.suite = r.suite AND (s.path = '' OR r.path = s.path OR starts_with(r.path, s.path || '.'))) THEN 'SKIP'
 WHEN m.value IS NULL THEN 'FAIL' WHEN op = 'min' THEN CASE WHEN m.value >= bound THEN 'OK' ELSE 'FAIL' END WHEN op = 'max' THEN CASE WHEN m.value <= bound THEN 'OK' ELSE 'FAIL' END ELSE CASE WHEN m.value = bound THEN 'OK' ELSE 'FAIL' END END AS status
FROM r LEFT JOIN m ON m.suite = r.suite AND m.path = r.path""")
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).cast("double").alias("count"), F.avg("l_quantity").alias("avg_qty"), F.max("l_extendedprice").alias("max_price"))
    m = g.unpivot(["l_returnflag", "l_linestatus"], ["count", "avg_qty", "max_price"], "name", "v").select(
        F.col("l_returnflag").alias("suite"), F.concat_ws(".", "l_linestatus", "name").alias("path"), r6(F.col("v")).alias("value"))
    return M.rule_check(m, spark.createDataFrame(RULES, "suite string, path string, op string, bound double"),
                        spark.createDataFrame(SKIPS, "suite string, path string"), spark.createDataFrame([(e,) for e in ERRORS], "suite string"))
