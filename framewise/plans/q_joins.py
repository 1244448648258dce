"""Record matching over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise import scale
from framewise.operators import intervals as I
from framewise.operators import joins as J
from framewise.plans import bindings as B
from framewise.plans.q_functions import r6
from framewise.plans.registry import query, table

GAP = 21600
SQL_SESSIONS = B.EV + f""", sg AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY reel ORDER BY i) - 1 AS sid FROM (SELECT *, lag(t) OVER (PARTITION BY reel ORDER BY i) AS p FROM ev)),
se AS (SELECT reel, sid::BIGINT AS session, min(t) AS "start", max(t) AS "end", min_by(k, i) AS k FROM sg GROUP BY ALL), dy AS (SELECT DISTINCT reel, floor(t / 86400)::BIGINT AS day FROM ev)"""


def sessions(spark, sf):
    """Gap sessions of each reel (truth) and one-day bins (candidates)."""
    ev = B.event_series(spark, sf).withColumn("o", F.col("i") - 1)
    gaps = scale.previous(ev, ["reel"], "o", {"p": "t"})
    new = F.when(F.col("p").isNull() | (F.col("t") - F.col("p") > GAP), 1).otherwise(0)
    marked = scale.running_sum(gaps.withColumn("new", new), ["reel"], "o", {"sid": F.col("new")})
    return marked.groupBy("reel", (F.col("sid") - 1).alias("session")).agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.min_by("k", "i").alias("k"))


def day_bins(spark, sf):
    ev = B.event_series(spark, sf)
    d = ev.select("reel", F.floor(F.col("t") / 86400).alias("day")).distinct()
    return d.select("reel", "day", (F.col("day") * 86400.0).alias("start"), ((F.col("day") + 1) * 86400.0).alias("end"))


@query("j1_best_overlap_join", f"""WITH {SQL_SESSIONS}, o AS (SELECT se.reel, se.session, dy.day, least(se."end", (dy.day + 1) * 86400) - greatest(se."start", dy.day * 86400) AS ov FROM se JOIN dy USING (reel)),
b AS (SELECT reel, session, day, ov FROM o WHERE ov > 0 QUALIFY row_number() OVER (PARTITION BY reel, session ORDER BY ov DESC, day) = 1)
SELECT se.reel, se.session, b.day, round(b.ov, 6) AS overlap FROM se LEFT JOIN b USING (reel, session)""")
def _(spark, sf):
    out = I.best_overlap(sessions(spark, sf), day_bins(spark, sf), ["reel"], "session", "day", 86400.0)
    return out.select("reel", "session", "day", r6(F.col("overlap")).alias("overlap"))


@query("j2_point_in_interval_join", f"""WITH {B.ES}, p AS (SELECT reel, i, t + CASE WHEN k % 5 = 0 THEN 3000000 ELSE 0 END AS t FROM ev)
SELECT p.reel, p.i, min(es.shot_idx) AS shot_idx FROM p LEFT JOIN es ON es.reel = p.reel AND p.t BETWEEN es."start" AND es."end" GROUP BY p.reel, p.i""")
def _(spark, sf):
    pts = B.event_series(spark, sf).select("reel", "i", (F.col("t") + F.when(F.col("k") % 5 == 0, 3000000).otherwise(0)).alias("t"))
    return I.point_in_interval(pts, B.event_shots(spark, sf), ["reel"], "t", "i", "shot_idx", 86400.0).select("reel", "i", "shot_idx")


@query("j3_rank_aligned_join", f"""WITH {B.LS}, r AS (SELECT plan, l_linestatus AS s, shot_idx, l_quantity AS x, row_number() OVER (PARTITION BY plan, l_linestatus ORDER BY l_quantity, shot_idx) AS rank, count(*) OVER (PARTITION BY plan, l_linestatus) AS n FROM ls)
SELECT a.plan, a.rank::INT AS rank, a.shot_idx AS id_a, b.shot_idx AS id_b, round(a.x - b.x, 6) AS dx FROM r a JOIN r b ON a.s = 'O' AND b.s = 'F' AND a.plan = b.plan AND a.rank = b.rank AND a.n = b.n""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    out = J.rank_aligned_join(ls.where("l_linestatus = 'O'"), ls.where("l_linestatus = 'F'"), ["plan"], "l_quantity", "shot_idx")
    return out.select("plan", "rank", "id_a", "id_b", r6(F.col("x_a") - F.col("x_b")).alias("dx"))


@query("j4_ordinal_join", f"""WITH {B.LS}, n AS (SELECT *, row_number() OVER (PARTITION BY plan, l_linestatus ORDER BY shot_idx) - 1 AS o FROM ls)
SELECT c.plan, c.o AS ord, CASE WHEN r.plan IS NULL OR r.l_partkey % 4 = 0 THEN 'skipped' WHEN c.l_linenumber = 7 THEN 'error' WHEN c.l_discount = 0 THEN 'no_person' ELSE 'ok' END AS status,
 CASE WHEN r.plan IS NULL OR r.l_partkey % 4 = 0 THEN NULL WHEN c.l_linenumber = 7 OR c.l_discount = 0 THEN 0.0::DOUBLE END AS score
FROM n c LEFT JOIN n r ON r.l_linestatus = 'F' AND r.plan = c.plan AND r.o = c.o WHERE c.l_linestatus = 'O'""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    side = lambda s: scale.ordinal(ls.where(F.col("l_linestatus") == s), ["plan"], ["shot_idx"], "ord")
    cap = side("O").select("plan", "ord", (F.col("l_linenumber") != 7).alias("readable"), F.when(F.col("l_discount") == 0, 0).otherwise(1).alias("people"))
    ref = side("F").select("plan", "ord", F.when(F.col("l_partkey") % 4 == 0, "").otherwise("main").alias("subject_role"))
    return J.ordinal_status_join(cap, ref, ["plan"], "ord").select("plan", "ord", "status", "score")


@query("j5_nearest_subject_join", f"""WITH {B.LS}, p AS (SELECT plan, shot_idx, l_quantity / 50 AS x, l_discount * 10 AS y, l_extendedprice AS k, max(l_extendedprice) OVER (PARTITION BY plan) AS mk, CASE WHEN plan % 7 <> 0 THEN (plan % 10) / 10 END AS px, (plan % 9) / 9 AS rx FROM ls),
d AS (SELECT *, CASE WHEN px IS NOT NULL THEN sqrt((x-px)**2 + (y-0.5)**2) ELSE abs(x - rx) END AS dist FROM p WHERE px IS NOT NULL OR k >= 0.5 * mk)
SELECT plan, shot_idx, round(dist, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY plan ORDER BY dist, k DESC, shot_idx) = 1""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    people = ls.select("plan", "shot_idx", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"), F.col("l_extendedprice").alias("strength"))
    shots = ls.select("plan").distinct().select("plan", F.when(F.col("plan") % 7 != 0, (F.col("plan") % 10) / 10).alias("px"), F.lit(0.5).alias("py"), ((F.col("plan") % 9) / 9).alias("ref_x"))
    return J.nearest_subject(people, shots, ["plan"], "shot_idx").withColumn("distance", r6(F.col("distance")))


@query("j6_over_shoulder_filter", f"""WITH {B.LS}, p AS (SELECT plan, shot_idx, l_discount * 100 AS lf, 1200 + l_tax * 1000 AS rg, l_extendedprice / 100 AS h, (['left', 'right', 'none'])[plan % 3 + 1] AS side FROM ls),
g AS (SELECT plan, list_sort(list(h)) AS hs FROM p GROUP BY plan), m AS (SELECT p.*, len(hs) >= 2 AND CASE WHEN side = 'left' THEN lf <= 4 WHEN side = 'right' THEN rg >= 1276 ELSE false END AND h >= 1.5 * hs[len(hs) // 2 + 1] AS front FROM p JOIN g USING (plan))
SELECT plan, shot_idx FROM m QUALIFY NOT front OR count(*) FILTER (WHERE NOT front) OVER (PARTITION BY plan) = 0""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    side = F.get(F.array(F.lit("left"), F.lit("right"), F.lit("none")), (F.col("plan") % 3).cast("int"))
    people = ls.select("plan", "shot_idx", (F.col("l_discount") * 100).alias("left"), (1200 + F.col("l_tax") * 1000).alias("right"),
                       (F.col("l_extendedprice") / 100).alias("height"), side.alias("side"))
    return J.drop_over_shoulder(people, ["plan"], "side", 1280).select("plan", "shot_idx")


@query("j9_prefix_match_join", """WITH s AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS src FROM part)
SELECT s.p_brand, s.src, arg_min(p.p_name, p.p_partkey) AS p_name, min(p.p_partkey) AS p_partkey FROM s JOIN part p ON p.p_brand = s.p_brand AND starts_with(p.p_name, s.src) GROUP BY ALL""")
def _(spark, sf):
    p = table(spark, sf, "part")
    return J.prefix_match_join(p.select("p_brand", F.substring_index("p_name", " ", 1).alias("src")), p, "p_brand", "src", "p_name", "p_partkey")


@query("j10_skeleton_partition_join", """WITH m AS (SELECT s_nationkey AS skeleton, coalesce(min(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END), min(s_suppkey)) AS mesh FROM supplier WHERE s_nationkey <> 4 GROUP BY 1),
a AS (SELECT l_partkey % 26 AS sk, l_partkey % 26 = 7 AS direct FROM lineitem)
SELECT CASE WHEN direct THEN 'direct' WHEN m.mesh IS NULL THEN 'skipped' ELSE 'retarget' END AS route, CASE WHEN NOT direct THEN m.mesh END AS source_mesh, count(*) AS n FROM a LEFT JOIN m ON m.skeleton = a.sk GROUP BY ALL""")
def _(spark, sf):
    meshes = table(spark, sf, "supplier").where("s_nationkey <> 4").select(
        F.col("s_nationkey").cast("bigint").alias("skeleton"), F.col("s_suppkey").alias("mesh"), (F.col("s_suppkey") % 3 == 0).alias("preview"))
    anim = table(spark, sf, "lineitem").select((F.col("l_partkey") % 26).alias("skeleton"))
    return J.skeleton_partition(anim, meshes, 7).groupBy("route", "source_mesh").agg(F.count(F.lit(1)).alias("n"))


@query("j11_cache_join", """WITH c AS (SELECT o_orderkey, md5(o_orderkey || '|' || floor(o_totalprice)::INT) AS fp FROM orders WHERE o_orderkey % 10 <> 0), p AS (SELECT o_orderkey, md5(o_orderkey || '|' || (floor(o_totalprice)::INT + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)) AS fp, o_orderkey % 11 <> 0 AS has FROM orders WHERE o_orderkey % 9 <> 0)
SELECT c.o_orderkey, CASE WHEN p.fp IS NULL THEN 'new' WHEN p.fp = c.fp AND has THEN 'cached' ELSE 'changed' END AS state FROM c LEFT JOIN p USING (o_orderkey) UNION ALL SELECT o_orderkey, 'removed' FROM p WHERE o_orderkey % 10 = 0""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    price = F.floor("o_totalprice").cast("int")
    fp = lambda extra: F.md5(F.concat(F.col("o_orderkey"), F.lit("|"), (price + extra).cast("string")))
    cur = o.where("o_orderkey % 10 <> 0").select("o_orderkey", fp(F.lit(0)).alias("fp"))
    prev = o.where("o_orderkey % 9 <> 0").select("o_orderkey", fp(F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("fp"), (F.col("o_orderkey") % 11 != 0).alias("has_plan"))
    return J.cache_join(cur, prev, "o_orderkey", "fp")


REQUESTS = [{"size": "wide", "angle": "eye"}, {"motion": "dolly_in"}, {"size": "close_up", "angle": "low", "people": 2}, {}, {"people": 1, "ots": True, "motion": "pan"}]


@query("j12_similarity_cross_join", f"""WITH {B.ES}, o AS (SELECT *, list_position(['extreme_close_up', 'close_up', 'medium', 'full', 'wide'], size) AS so FROM es), s AS (SELECT reel, shot_idx,
 [(1.0 * greatest(0.0, 1 - abs(so - 5) / 2) + 0.7 * CASE WHEN angle = 'eye' THEN 1.0 WHEN angle IN ('low', 'high') THEN 0.35 ELSE 0.0 END) / 1.7, CASE motion WHEN 'dolly_in' THEN 1.0 WHEN 'zoom_in' THEN 0.6 ELSE 0.0 END,
 (greatest(0.0, 1 - abs(so - 2) / 2) + 0.7 * CASE angle WHEN 'low' THEN 1.0 WHEN 'eye' THEN 0.35 ELSE 0.0 END + 0.8 * CASE WHEN people = 2 THEN 1.0 WHEN people > 2 THEN 0.3 ELSE 0.2 END) / 2.5, 0.5,
 (0.8 * CASE motion WHEN 'pan' THEN 1.0 WHEN 'tracking' THEN 0.5 WHEN 'tilt' THEN 0.4 WHEN 'orbit' THEN 0.4 ELSE 0.0 END + 0.8) / 1.6] AS sims FROM o)
SELECT reel, shot_idx, generate_subscripts(sims, 1)::INT - 1 AS request, round(unnest(sims)::DOUBLE, 6) AS sim FROM s""")
def _(spark, sf):
    s = J.similarity_array(B.event_shots(spark, sf), REQUESTS)
    return s.select("reel", "shot_idx", F.posexplode("sims").alias("request", "sim")).withColumn("sim", r6(F.col("sim")))


@query("j13_nearest_key_resample", f"""WITH {B.EV}, n AS (SELECT reel, count(*) AS n FROM ev GROUP BY reel HAVING count(*) >= 2)
SELECT n.reel, r.k::INT AS key, ev.i - 1 AS o, value FROM n, range(0, 24) r(k) JOIN ev ON ev.reel = n.reel AND ev.i - 1 = greatest(0, least(n.n - 1, floor(r.k * (n.n - 1) / 23 + 0.5)))""")
def _(spark, sf):
    s = B.event_series(spark, sf).select("reel", (F.col("i") - 1).alias("o"), "value")
    return J.nearest_key_resample(s, ["reel"], "o", 24)


SQL_CURVE = B.EV + """, cv AS (SELECT reel, i, (t % 86400) / 86400 AS r, value AS a, k::DOUBLE AS b, 0.2 + (reel % 7) / 10 AS at_ FROM ev)"""


def curves(spark, sf):
    ev = B.event_series(spark, sf)
    c = ev.select("reel", "i", ((F.col("t") % 86400) / 86400).alias("r"), F.col("value").alias("a"), F.col("k").cast("double").alias("b"))
    return c, ev.select("reel").distinct().select("reel", (0.2 + (F.col("reel") % 7) / 10).alias("at"))


@query("j14_curve_bracket_join", f"""WITH {SQL_CURVE}, g AS (SELECT reel, any_value(at_) AS x, max(CASE WHEN r <= at_ THEN {{'r': r, 'a': a, 'b': b}} END) AS lo, min(CASE WHEN r >= at_ THEN {{'r': r, 'a': a, 'b': b}} END) AS hi FROM cv GROUP BY reel)
SELECT reel, round(lo.a + (hi.a - lo.a) * CASE WHEN hi.r = lo.r THEN 0.0 ELSE (x - lo.r) / (hi.r - lo.r) END, 6) AS a, round(lo.b + (hi.b - lo.b) * CASE WHEN hi.r = lo.r THEN 0.0 ELSE (x - lo.r) / (hi.r - lo.r) END, 6) AS b FROM g""")
def _(spark, sf):
    c, w = curves(spark, sf)
    return J.curve_bracket(c, w, ["reel"], "r", ["a", "b"]).select("reel", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query("j15_nearest_curve_point", f"""WITH {SQL_CURVE} SELECT reel, a, b FROM cv QUALIFY row_number() OVER (PARTITION BY reel ORDER BY abs(r - at_), i) = 1""")
def _(spark, sf):
    c, w = curves(spark, sf)
    return J.nearest_curve_point(c, w, ["reel"], "r", ["a", "b"], "i")


MIRROR = {f"{a}{p}": f"{b}{p}" for p in ("UpperArm", "LowerArm", "Hand", "Thigh", "Calf", "Foot") for a, b in (("Left", "Right"), ("Right", "Left"))}


@query("j17_best_mapping_join", f"""WITH {B.PO}, m AS (SELECT unnest({list(MIRROR)}) AS role, unnest({list(MIRROR.values())}) AS flipped), v AS (SELECT 'd' AS variant, role, role AS bone FROM m UNION ALL SELECT 'm', role, flipped FROM m),
e AS (SELECT t.pair, t.sample, variant, avg(sqrt((t.x-s.x)**2 + (t.y-s.y)**2)) AS e FROM po t JOIN v ON v.role = t.role JOIN po s ON s.pair = t.pair AND s.sample = t.sample AND s.role = v.bone AND s.side = 's' WHERE t.side = 't' GROUP BY ALL),
b AS (SELECT pair, sample, min(e) AS error FROM e GROUP BY ALL), h AS (SELECT f.pair, f.sample, max(abs(h.y - f.y)) AS span FROM po f JOIN po h ON h.pair = f.pair AND h.sample = f.sample AND h.side = 's' AND h.role = 'Head' WHERE f.side = 's' AND f.role IN ('LeftFoot', 'RightFoot') GROUP BY ALL)
SELECT pair, round(median(error), 6) AS error, round(median(CASE WHEN span > 1e-6 THEN error / span END), 6) AS body_error FROM b LEFT JOIN h USING (pair, sample) GROUP BY pair""")
def _(spark, sf):
    po = B.poses(spark, sf)
    src = po.where("side = 's'")
    body = src.groupBy("pair", "sample").agg(
        F.max(F.when(F.col("role") == "Head", F.col("y"))).alias("h"), F.max(F.when(F.col("role") == "LeftFoot", F.col("y"))).alias("l"),
        F.max(F.when(F.col("role") == "RightFoot", F.col("y"))).alias("r")).select(
        "pair", "sample", F.greatest(F.abs(F.col("h") - F.col("l")), F.abs(F.col("h") - F.col("r"))).alias("span"))
    per = J.best_mapping(po, ["pair", "sample"], MIRROR, body)
    # a clip has at most 128 samples
    return per.groupBy("pair").agg(r6(F.median("error")).alias("error"), r6(F.median("body_error")).alias("body_error"))


@query("j19_foreground_role_pick", f"""WITH {B.LS}, s AS (SELECT plan, shot_idx, 'role_' || (l_partkey % 4) AS role, l_partkey % 4 <> 3 AS cst FROM ls), h AS (SELECT plan, 'role_' || (l_partkey % 4) AS anchor, l_quantity AS ax FROM ls WHERE shot_idx = 0),
c AS (SELECT plan, role, count(*) AS n, min(shot_idx) AS o FROM s WHERE cst GROUP BY ALL), f AS (SELECT c.plan, role FROM c JOIN h USING (plan) WHERE role <> anchor QUALIFY row_number() OVER (PARTITION BY c.plan ORDER BY n DESC, o) = 1),
a AS (SELECT ls.plan, 'sup_' || l_suppkey AS actor FROM ls JOIN h USING (plan) WHERE shot_idx > 0 QUALIFY row_number() OVER (PARTITION BY ls.plan ORDER BY abs(l_quantity - ax), 'sup_' || l_suppkey) = 1)
SELECT h.plan, coalesce(f.role, a.actor) AS foreground, CASE WHEN f.role IS NOT NULL THEN 'frequent' WHEN a.actor IS NOT NULL THEN 'nearest' ELSE 'none' END AS source FROM h LEFT JOIN f USING (plan) LEFT JOIN a USING (plan)""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    role = F.concat(F.lit("role_"), F.col("l_partkey") % 4)
    subjects = ls.select("plan", F.col("shot_idx").alias("ord"), role.alias("role"), (F.col("l_partkey") % 4 != 3).alias("cast"))
    shots = ls.where("shot_idx = 0").select("plan", role.alias("anchor"), F.col("l_quantity").alias("ax"))
    actors = ls.where("shot_idx > 0").select("plan", F.concat(F.lit("sup_"), "l_suppkey").alias("actor"), F.col("l_quantity").alias("x"))
    return J.foreground_role(subjects, shots, actors, "plan")


SQL_HIT = """(sqrt(({x0} + ({x1} - {x0}) * {t} - {ax})**2 + ({y0} + ({y1} - {y0}) * {t} - {ay})**2) <= greatest(15.0, {tall} * 0.14) AND {z0} + ({z1} - {z0}) * {t} BETWEEN 0 AND {tall})"""


def sql_hit(x0, y0, z0, x1, y1, z1, ax, ay, tall):
    length = f"(({x1} - {x0})**2 + ({y1} - {y0})**2)"
    t = f"CASE WHEN {length} > 1e-4 THEN greatest(0.0, least(1.0, (({ax} - {x0}) * ({x1} - {x0}) + ({ay} - {y0}) * ({y1} - {y0})) / {length})) ELSE 0.0 END"
    return SQL_HIT.format(x0=x0, y0=y0, z0=z0, x1=x1, y1=y1, z1=z1, ax=ax, ay=ay, tall=tall, t=t)


def _turned(i: int) -> str:
    """One step of turning the camera until the anchor is seen at its wanted place."""
    depth = "(-cx*cos(p)*cos(w) - cy*cos(p)*sin(w) + (fz-cz)*sin(p))"
    seen = f"t{i} AS (SELECT * REPLACE (CASE WHEN go THEN w - atan(ex * th) ELSE w END AS w, CASE WHEN go THEN p - atan(eu * tv) ELSE p END AS p) FROM (SELECT *, d > 1e-4 AND (abs(ex) >= 0.001 OR abs(eu) >= 0.001) AS go FROM ("
    return seen + f"""SELECT *, 2 * (wx - (0.5 + 0.5 * ((cx*sin(w) - cy*cos(w)) / d) / th)) AS ex, 2 * (0.5 - 0.5 * ((cx*sin(p)*cos(w) + cy*sin(p)*sin(w) + (fz-cz)*cos(p)) / d) / tv - wy) AS eu FROM (
 SELECT * EXCLUDE (d, ex, eu, go), {depth} AS d FROM t{i - 1}))))"""


@query("j20_grid_search_argmin", f"""WITH {B.LS}, an AS (SELECT plan, 200 + l_extendedprice / 100 AS dist, (l_quantity - 25) * 4 AS side, (l_discount - 0.05) * 1000 AS hh, 20 + l_quantity AS lens, 150.0 + l_linenumber * 5 AS body,
 (['0.5', '0.72', '0.88'])[l_partkey % 3 + 1]::DOUBLE AS foc, 0.3 + l_tax * 5 AS wx, 0.35 + l_discount * 3 AS wy, 1.0 + (l_suppkey % 3) / 2 AS aspect FROM ls WHERE shot_idx = 0),
ob AS (SELECT plan, shot_idx, (l_discount - 0.05) * 4000 AS x, (l_tax - 0.04) * 5000 AS y, 150.0 + l_linenumber * 5 AS h, l_quantity / 50 AS sx, 0.5 + l_discount * 10 AS ratio FROM ls WHERE shot_idx > 0),
ca AS (SELECT *, greatest(30.0, sqrt(dist*dist + side*side)) AS r, degrees(atan2(side, dist)) AS base, g * 2.5 - 75.0 AS angle, 18.0 / lens AS th, 18.0 / lens / aspect AS tv FROM an, range(0, 61) t(g)),
cb AS (SELECT *, r * cos(radians(angle)) AS cx, r * sin(radians(angle)) AS cy, body * foc + hh AS cz, body * foc AS fz FROM ca),
t0 AS (SELECT *, atan2(fz - cz, sqrt(cx*cx + cy*cy)) AS p, atan2(-cy, -cx) AS w, 0.0 AS d, 0.0 AS ex, 0.0 AS eu, false AS go FROM cb),
{', '.join(_turned(i) for i in range(1, 7))},
cd AS (SELECT *, -cx*cos(p)*cos(w) - cy*cos(p)*sin(w) + (fz-cz)*sin(p) AS d0 FROM t6),
oo AS (SELECT cd.plan, cd.g, (ob.x-cx)*cos(p)*cos(w) + (ob.y-cy)*cos(p)*sin(w) + (ob.h*0.5-cz)*sin(p) AS depth, -(ob.x-cx)*sin(w) + (ob.y-cy)*cos(w) AS across, d0, body, lens, ob.h, ob.sx, ob.ratio,
 {sql_hit('cx', 'cy', 'cz', 'ob.x', 'ob.y', 'ob.h*0.5', '0.0', '0.0', 'body')} AS hidden, {' OR '.join('(' + sql_hit('cx', 'cy', 'cz', '0.0', '0.0', f'(body*{up})', 'ob.x', 'ob.y', 'ob.h') + ')' for up in ('foc', '0.9', '0.65'))} AS blocks FROM cd JOIN ob USING (plan)),
oc AS (SELECT plan, g, sum(CASE WHEN depth <= 1e-4 THEN 5.0 ELSE 4.0 * (0.5 + 0.5 * (across / depth) / (36.0 / (2 * lens)) - sx)**2 + CASE WHEN d0 > 1 AND depth > 1 AND ratio > 0.01 THEN 0.5 * ln((h / depth) / (body / d0) / ratio)**2 ELSE 0.0 END + CASE WHEN hidden THEN 2.0 ELSE 0.0 END END) AS c, bool_or(blocks) AS blocked FROM oo GROUP BY ALL),
fin AS (SELECT cd.plan, cd.g, cd.angle, round(0.3 * ((angle - base) / 75.0)**2 + CASE WHEN blocked THEN 10.0 ELSE 0.0 END + coalesce(c, 0.0), 9) AS cost FROM cd LEFT JOIN oc USING (plan, g))
SELECT plan, angle::DOUBLE AS angle, cost::DOUBLE AS cost FROM fin QUALIFY row_number() OVER (PARTITION BY plan ORDER BY cost, g) = 1""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    first = F.col("shot_idx") == 0
    at = lambda c: F.max(F.when(first, c))
    other = {"ox": (F.col("l_discount") - 0.05) * 4000, "oy": (F.col("l_tax") - 0.04) * 5000, "oh": 150.0 + F.col("l_linenumber") * 5,
             "osx": F.col("l_quantity") / 50, "oratio": 0.5 + F.col("l_discount") * 10}
    people = F.collect_list(F.when(~first, F.struct(*[c.alias(n) for n, c in other.items()])))
    shots = ls.groupBy("plan").agg(
        at(200 + F.col("l_extendedprice") / 100).alias("distance"), at((F.col("l_quantity") - 25) * 4).alias("side"), at((F.col("l_discount") - 0.05) * 1000).alias("height"),
        at(20 + F.col("l_quantity")).alias("lens"), at(150.0 + F.col("l_linenumber") * 5).alias("body"),
        at(F.get(F.array(F.lit(0.5), F.lit(0.72), F.lit(0.88)), (F.col("l_partkey") % 3).cast("int"))).alias("focus"), at(0.3 + F.col("l_tax") * 5).alias("screen_x"),
        at(0.35 + F.col("l_discount") * 3).alias("screen_y"), at(1.0 + (F.col("l_suppkey") % 3) / 2).alias("aspect"), people.alias("o"))
    shots = shots.select("plan", "distance", "side", "height", "lens", "body", "focus", "screen_x", "screen_y", "aspect", *[F.col(f"o.{n}").alias(n) for n in other])
    return J.grid_search_azimuth(shots, ["plan"])


@query("j21_masked_diff_region", f"""WITH {B.FR}, pr AS (SELECT clip, frame, sig AS a, lag(sig) OVER (PARTITION BY clip ORDER BY frame) AS b FROM fr), px AS (SELECT clip, frame, i % 8 AS x, i // 8 AS y, abs(a[i+1] - b[i+1]) > 0.35 AS m FROM pr, range(0, 64) r(i) WHERE b IS NOT NULL),
g AS (SELECT clip, frame, avg(m::INT) AS area, min(x) FILTER (WHERE m) AS x0, max(x) FILTER (WHERE m) AS x1, min(y) FILTER (WHERE m) AS y0, max(y) FILTER (WHERE m) AS y1, avg(x) FILTER (WHERE m) AS cx FROM px GROUP BY ALL)
SELECT clip, frame, round(area, 6) AS area, CASE WHEN area >= 0.03 THEN x0 / 8 END AS x0, CASE WHEN area >= 0.03 THEN x1 / 8 END AS x1, CASE WHEN area >= 0.03 THEN y0 / 8 END AS y0, CASE WHEN area >= 0.03 THEN y1 / 8 END AS y1,
 CASE WHEN area >= 0.03 THEN round(cx / 8, 6) END AS center_x, CASE WHEN area >= 0.03 THEN CASE WHEN cx / 8 < 0.5 THEN 'left' ELSE 'right' END END AS side FROM g""")
def _(spark, sf):
    pairs = scale.previous(B.frames(spark, sf), ["clip"], "frame", {"plain": "sig"}).where("plain IS NOT NULL")
    out = J.masked_diff_region(pairs, "sig", "plain", 8, 0.35, 0.03)
    return out.select("clip", "frame", r6(F.col("area")).alias("area"), "x0", "x1", "y0", "y1", r6(F.col("center_x")).alias("center_x"), "side")


@query("j22_expected_ots_side", f"""WITH {B.LS}, s AS (SELECT plan, shot_idx, l_extendedprice / 100 - 100 AS depth, CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_quantity / 25 - 0.5 END AS hx, l_discount * 15 - 0.2 AS hy, l_quantity / 20 - 0.6 AS mx, l_tax * 20 - 0.2 AS my FROM ls),
v AS (SELECT *, coalesce(hx BETWEEN -0.02 AND 1.02 AND hy BETWEEN -0.02 AND 1.02, false) OR (mx BETWEEN -0.02 AND 1.02 AND my BETWEEN -0.02 AND 1.02) AS vis FROM s), n AS (SELECT *, min(depth) FILTER (WHERE vis) OVER (PARTITION BY plan) AS near FROM v),
f AS (SELECT plan, arg_min(hx, shot_idx) AS hx FROM n WHERE NOT vis AND depth > 0 AND depth < near AND hx BETWEEN -1 AND 2 GROUP BY plan)
SELECT p.plan, CASE WHEN hx > 0.5 THEN 'right' WHEN hx IS NOT NULL THEN 'left' ELSE '' END AS side FROM (SELECT DISTINCT plan FROM ls) p LEFT JOIN f USING (plan)""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    s = ls.select("plan", "shot_idx", (F.col("l_extendedprice") / 100 - 100).alias("depth"), F.when(F.col("l_partkey") % 8 != 0, F.col("l_quantity") / 25 - 0.5).alias("head_x"),
                  (F.col("l_discount") * 15 - 0.2).alias("head_y"), (F.col("l_quantity") / 20 - 0.6).alias("mid_x"), (F.col("l_tax") * 20 - 0.2).alias("mid_y"))
    return J.expected_over_shoulder(s, ["plan"], "shot_idx")


@query("j23_within_radius_join", f"""WITH {B.FR}, a AS (SELECT clip, frame, sig[1] * 9000 AS x, sig[2] * 9000 AS y, frame % 4 = 0 AS req FROM fr), s AS (SELECT * FROM a),
p AS (SELECT s.clip, s.frame, o.frame AS of, o.req, sqrt((s.x-o.x)**2 + (s.y-o.y)**2) AS d FROM s LEFT JOIN a o ON o.clip = s.clip AND o.frame <> s.frame)
SELECT clip, frame, count(*) FILTER (WHERE d <= 1600) AS occluders, count(*) FILTER (WHERE d <= 800) AS staged, coalesce(bool_and(d <= 800) FILTER (WHERE req), true) AS all_staged FROM p GROUP BY ALL""")
def _(spark, sf):
    fr = B.frames(spark, sf).select("clip", "frame", (F.get("sig", F.lit(0)) * 9000).alias("x"), (F.get("sig", F.lit(1)) * 9000).alias("y"), (F.col("frame") % 4 == 0).alias("required"))
    shots = fr.select("clip", "frame", F.col("x").alias("ax"), F.col("y").alias("ay"))
    return J.within_radius(shots, fr.withColumnRenamed("frame", "actor"), "clip", "frame", "actor", 800.0, 1600.0)
