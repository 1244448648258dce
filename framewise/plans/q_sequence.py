"""Sequence search, casting and placement over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import scorecards as SC
from framewise.operators import sequence as Q
from framewise.plans import bindings as B
from framewise.plans.q_functions import r6
from framewise.plans.q_joins import MIRROR
from framewise.plans.registry import query, table

PROMPT = "wide establishing shot at the harbour then push in with two people then low angle close-up"
REQUEST = [{"size": "wide"}, {"motion": "dolly_in", "people": 2}, {"size": "close_up", "angle": "low"}]
TIE = 1e-12
SQL_SIMS = B.ES + """, o AS (SELECT *, list_position(['extreme_close_up', 'close_up', 'medium', 'full', 'wide'], size) AS so FROM es),
sm AS (SELECT reel, shot_idx + 1 AS j, "start", "end", people, confidence, greatest(0.0, 1 - abs(so - 5) / 2)::DOUBLE AS s1,
 ((0.8 * CASE motion WHEN 'dolly_in' THEN 1.0 WHEN 'zoom_in' THEN 0.6 ELSE 0.0 END + 0.8 * CASE WHEN people = 2 THEN 1.0 WHEN people > 2 THEN 0.3 ELSE 0.2 END) / 1.6)::DOUBLE AS s2,
 ((greatest(0.0, 1 - abs(so - 2) / 2) + 0.7 * CASE angle WHEN 'low' THEN 1.0 WHEN 'eye' THEN 0.35 ELSE 0.0 END) / 1.7)::DOUBLE AS s3 FROM o)"""


def _cell(i: int) -> str:
    """SQL of one cell: value, first shot and match count of the best path ending there."""
    diag = f"d.p{i - 1}" if i > 1 else "{'v': 0.0::DOUBLE, 's': 0::BIGINT, 'n': 0}"
    up = f"c{i - 1}" if i > 1 else "{'v': 0.0::DOUBLE, 's': 0::BIGINT, 'n': 0}"
    m, u, l = f"({diag}.v + sm.s{i} - 0.55)", f"({up}.v - 0.6)", f"(d.p{i}.v - 0.1)"
    return (f"CASE WHEN greatest({m}, {u}, {l}) <= 0 THEN {{'v': 0.0::DOUBLE, 's': 0::BIGINT, 'n': 0}} WHEN {m} >= {u} AND {m} >= {l} THEN "
            f"{{'v': {m}, 's': CASE WHEN {diag}.v > 0 THEN {diag}.s ELSE sm.j END, 'n': {diag}.n + 1}} WHEN {u} >= {l} THEN {{'v': {u}, 's': {up}.s, 'n': {up}.n}} ELSE {{'v': {l}, 's': d.p{i}.s, 'n': d.p{i}.n}} END")


ZERO = "{'v': 0.0::DOUBLE, 's': 0::BIGINT, 'n': 0}"
# row 2 and 3 need the cell above in the same column, so the recursion steps through (column, row)
SQL_ALIGN = f"""{SQL_SIMS}, dp AS (SELECT reel, 0::BIGINT AS j, 0 AS i, {ZERO} AS p1, {ZERO} AS p2, {ZERO} AS p3, {ZERO} AS c1, {ZERO} AS c2, {ZERO} AS c3 FROM (SELECT DISTINCT reel FROM sm)
 UNION ALL SELECT reel, j, i, p1, p2, p3, c1, c2, c3 FROM (
  SELECT sm.reel, sm.j, 1 AS i, d.c1 AS p1, d.c2 AS p2, d.c3 AS p3, {_cell(1).replace('d.p', 'd.c')} AS c1, d.c2, d.c3 FROM dp d JOIN sm ON sm.reel = d.reel AND sm.j = d.j + 1 WHERE d.i IN (0, 3)
  UNION ALL SELECT d.reel, d.j, 2, d.p1, d.p2, d.p3, d.c1, {_cell(2)}, d.c3 FROM dp d JOIN sm ON sm.reel = d.reel AND sm.j = d.j WHERE d.i = 1
  UNION ALL SELECT d.reel, d.j, 3, d.p1, d.p2, d.p3, d.c1, d.c2, {_cell(3)} FROM dp d JOIN sm ON sm.reel = d.reel AND sm.j = d.j WHERE d.i = 2)),
ce AS (SELECT reel, j, i, CASE i WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS c FROM dp WHERE i > 0),
al AS (SELECT reel, CASE WHEN c.v > 0 THEN c.v ELSE 0.0 END AS raw, CASE WHEN c.v > 0 THEN c.s - 1 ELSE -1 END AS start_shot, CASE WHEN c.v > 0 THEN j - 1 ELSE -1 END AS end_shot, CASE WHEN c.v > 0 THEN c.n ELSE 0 END AS n FROM ce
 QUALIFY row_number() OVER (PARTITION BY reel ORDER BY round(c.v, 12) DESC, i, j) = 1)"""


@query("q1_local_align", f"WITH RECURSIVE {SQL_ALIGN} SELECT reel, round(least(1.0, raw / 1.35), 6) AS score, start_shot, end_shot, round(n / 3, 6) AS coverage FROM al")
def _(spark, sf):
    a = Q.local_align(B.event_shots(spark, sf), REQUEST, ["reel"], tie=TIE)
    return a.select("reel", r6(F.col("score")).alias("score"), "start_shot", "end_shot", r6(F.col("coverage")).alias("coverage"))


def reel_videos(spark, sf):
    es = B.event_shots(spark, sf)
    user = F.col("reel")
    name = F.concat(F.lit("lib/"), F.when(user % 5 == 0, "Harbour_").otherwise("clip_"), user, F.lit(".mp4"))
    return es.groupBy("reel").agg(F.max("people").alias("people")).select("reel", name.alias("path"), "people")


SQL_RANK = f"""{SQL_ALIGN}, vd AS (SELECT reel, max(people) AS people FROM sm GROUP BY reel),
cf AS (SELECT al.reel, avg(sm.confidence) AS conf, min(sm."start") AS s, max(sm."end") AS e FROM al JOIN sm ON sm.reel = al.reel AND sm.j - 1 BETWEEN al.start_shot AND al.end_shot GROUP BY al.reel),
fi AS (SELECT al.reel, al.start_shot, al.end_shot, round(100 * least(1.0, least(1.0, raw / 1.35) * CASE WHEN people < 2 THEN 0.6 ELSE 1.0 END + CASE WHEN al.reel % 5 = 0 THEN 0.05 ELSE 0.0 END), 1) AS score, round(n / 3, 2) AS coverage, conf FROM al JOIN vd USING (reel) JOIN cf USING (reel) WHERE raw > 0)
SELECT reel, start_shot, end_shot, score::DOUBLE AS score, coverage::DOUBLE AS coverage, round(conf, 6) AS confidence FROM fi ORDER BY score DESC, coverage DESC, conf DESC, reel LIMIT 5"""


@query("t1_rank_results", f"WITH RECURSIVE {SQL_RANK}")
def _(spark, sf):
    a = Q.local_align(B.event_shots(spark, sf), REQUEST, ["reel"], tie=TIE)
    out = Q.rank_results(a, reel_videos(spark, sf), ["reel"], {"people_required": 2, "keywords": ["harbour"]}, 5)
    return out.select("reel", "start_shot", "end_shot", "score", "coverage", r6(F.col("confidence")).alias("confidence"))


@query("q2_library_search", f"WITH RECURSIVE {SQL_RANK}")
def _(spark, sf):
    out = Q.library_search(B.event_shots(spark, sf), reel_videos(spark, sf), ["reel"], PROMPT, 5, tie=TIE)
    return out.select("reel", "start_shot", "end_shot", "score", "coverage", r6(F.col("confidence")).alias("confidence"))


SQL_FOUND = f"""{SQL_RANK.replace(chr(10) + "SELECT reel", "," + chr(10) + "rk AS (SELECT reel")}),
sg AS (SELECT rk.reel, CASE WHEN rk.reel % 5 = 0 THEN 'Harbour_' ELSE 'clip_' END || rk.reel || '_seg' || (start_shot + 1) || '_' || (end_shot + 1) AS title, es.shot_idx, es.name, es."start" AS s, es."end" AS e, min(es."start") OVER (PARTITION BY rk.reel) AS origin
 FROM rk JOIN es ON es.reel = rk.reel AND es.shot_idx BETWEEN start_shot AND end_shot)
SELECT reel, title, shot_idx, name, round(origin, 3) AS origin, round(s - origin, 3) AS "start", round(e - origin, 3) AS "end" FROM sg"""


@query("q2_found_segments", f"WITH RECURSIVE {SQL_FOUND}")
def _(spark, sf):
    """The shots that the search found, as segments of their own."""
    es, videos = B.event_shots(spark, sf), reel_videos(spark, sf)
    out = Q.found_segments(Q.library_search(es, videos, ["reel"], PROMPT, 5, tie=TIE), es, videos, ["reel"])
    return out.select("reel", "title", "shot_idx", "name", F.round("origin", 3).alias("origin"), "start", "end")


@query("k3_write_segment_plan", f"""WITH {B.ES}, n AS (SELECT reel, count(*) AS n FROM es GROUP BY reel), m AS (SELECT es.*, n // 3 AS a, least(2 * n // 3, n - 1) AS b FROM es JOIN n USING (reel)), s AS (SELECT *, floor("start" * 1000) / 1000 AS s0, floor("end" * 1000) / 1000 AS e0 FROM m WHERE shot_idx BETWEEN a AND b),
o AS (SELECT *, min(s0) OVER (PARTITION BY reel) AS origin FROM s)
SELECT reel, 'Reel_' || reel || '_seg' || (a + 1) || '_' || (b + 1) AS title, shot_idx, name, round(origin, 3) AS origin, round(s0 - origin, 3) AS "start", round(e0 - origin, 3) AS "end" FROM o""")
def _(spark, sf):
    es = B.event_shots(spark, sf).withColumns({c: F.floor(F.col(c) * 1000) / 1000 for c in ("start", "end")})
    n = F.col("n")
    part = es.groupBy("reel").agg(F.count(F.lit(1)).alias("n")).select(
        "reel", F.concat(F.lit("Reel_"), "reel").alias("title"), F.floor(n / 3).alias("first"), F.least(F.floor(2 * n / 3), n - 1).alias("last"))
    out = Q.segment_shots(es, part, ["reel"])
    return out.select("reel", "title", "shot_idx", "name", F.round("origin", 3).alias("origin"), "start", "end")


@query("q4_best_pass_tracking", f"""WITH RECURSIVE {B.EV}, ps AS (SELECT reel, floor(t / 86400)::BIGINT AS shot, i, CASE event_type WHEN 'error' THEN 'no_person' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END::DOUBLE AS score FROM ev),
nu AS (SELECT *, row_number() OVER (PARTITION BY reel, shot ORDER BY i) AS n FROM ps WHERE status <> 'skipped'), fo AS (SELECT DISTINCT reel, shot, 0::BIGINT AS n, (-1.0)::DOUBLE AS best, NULL::BIGINT AS bp, NULL::VARCHAR AS st, 1.0::DOUBLE AS step, 0 AS corr FROM ps
 UNION ALL SELECT reel, shot, n, nb, CASE WHEN better THEN i ELSE bp END, ns, nstep, corr + CASE WHEN nb < 92 AND nstep >= 0.2 AND ns = 'ok' THEN 1 ELSE 0 END FROM (SELECT f.reel, f.shot, nu.n, nu.i, f.bp, f.corr, f.best < 0 OR nu.score > f.best + 0.5 AS better,
  CASE WHEN f.best < 0 OR nu.score > f.best + 0.5 THEN nu.score ELSE f.best END AS nb, CASE WHEN f.best < 0 OR nu.score > f.best + 0.5 THEN nu.status ELSE f.st END AS ns, CASE WHEN f.best < 0 OR nu.score > f.best + 0.5 THEN f.step ELSE f.step * 0.5 END AS nstep
  FROM fo f JOIN nu ON nu.reel = f.reel AND nu.shot = f.shot AND nu.n = f.n + 1))
SELECT reel, shot, CASE WHEN best >= 0 THEN best END AS best, bp AS best_pass, step, corr AS corrections FROM fo QUALIFY row_number() OVER (PARTITION BY reel, shot ORDER BY n DESC) = 1""")
def _(spark, sf):
    ev = B.event_series(spark, sf)
    status = F.when(F.col("event_type") == "error", "no_person").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    p = ev.select("reel", F.floor(F.col("t") / 86400).alias("shot"), "i", status.alias("status"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("score"))
    return Q.best_pass(p, ["reel", "shot"], "i")


def placed_subjects(spark, sf):
    ls = B.order_shots(spark, sf)
    ref = ls.where("shot_idx = 0").select("plan", (F.col("l_quantity") / 50).alias("ref_x"), (F.col("l_tax") * 10 + 0.05).alias("ref_height"),
                                          (100 + F.col("l_extendedprice") / 200).alias("distance"), (20 + F.col("l_quantity")).alias("lens"),
                                          F.cos(F.col("l_linenumber") * 1.0).alias("fx"), F.sin(F.col("l_linenumber") * 1.0).alias("fy"))
    s = ls.select("plan", F.col("shot_idx").alias("subject_idx"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_tax") * 10 + 0.05).alias("height"), (35 + F.col("l_discount") * 300).alias("radius"))
    return s.join(ref, "plan").withColumns({"anchor_x": F.lit(0.0), "anchor_y": F.lit(0.0)})


@query("q5_place_offsets", f"""WITH {B.LS}, rf AS (SELECT plan, l_quantity / 50 AS rx, l_tax * 10 + 0.05 AS rh, 100 + l_extendedprice / 200 AS d, 20 + l_quantity AS lens, cos(l_linenumber) AS fx, sin(l_linenumber) AS fy FROM ls WHERE shot_idx = 0),
o AS (SELECT ls.plan, shot_idx, fx, fy, (l_quantity / 50 - rx) * 2 * d * (18.0 / greatest(1.0, lens)) AS ac, greatest(-0.7 * d, least(3 * d, d * (rh / (l_tax * 10 + 0.05) - 1))) AS dp FROM ls JOIN rf USING (plan))
SELECT plan, shot_idx AS subject_idx, round(fy * ac - fx * dp, 5) AS wx, round(-fx * ac - fy * dp, 5) AS wy FROM o""")
def _(spark, sf):
    return Q.place_offsets(placed_subjects(spark, sf)).select("plan", "subject_idx", F.round("wx", 5).alias("wx"), F.round("wy", 5).alias("wy"))


SQL_PLACE = f"""{B.LS}, rf AS (SELECT plan, l_quantity / 50 AS rx, l_tax * 10 + 0.05 AS rh, 100 + l_extendedprice / 200 AS d, 20 + l_quantity AS lens, cos(l_linenumber) AS fx, sin(l_linenumber) AS fy FROM ls WHERE shot_idx = 0),
o AS (SELECT ls.plan, shot_idx, fx, fy, 35 + l_discount * 300 AS r, (l_quantity / 50 - rx) * 2 * d * (18.0 / greatest(1.0, lens)) AS ac, greatest(-0.7 * d, least(3 * d, d * (rh / (l_tax * 10 + 0.05) - 1))) AS dp FROM ls JOIN rf USING (plan)),
sb AS (SELECT plan, shot_idx, r, -fy AS ux, fx AS uy, fy * ac - fx * dp AS x, -fx * ac - fy * dp AS y FROM o),
pl AS (SELECT plan, shot_idx, 0 AS k, x, y, ux, uy, r, []::STRUCT(i BIGINT, x DOUBLE, y DOUBLE, r DOUBLE)[] AS done FROM sb WHERE shot_idx = 0
 UNION ALL SELECT m.plan, m.shot_idx, m.k, CASE WHEN m.push THEN m.x ELSE n.x END, CASE WHEN m.push THEN m.y ELSE n.y END, CASE WHEN m.push THEN m.ux ELSE n.ux END, CASE WHEN m.push THEN m.uy ELSE n.uy END, CASE WHEN m.push THEN m.r ELSE n.r END, m.done FROM (
  SELECT plan, push, ux, uy, r, CASE WHEN push THEN shot_idx ELSE shot_idx + 1 END AS shot_idx, CASE WHEN push THEN k + 1 ELSE 0 END AS k, CASE WHEN push THEN x + ux * CASE WHEN k % 2 = 0 THEN r ELSE -r END END AS x,
   CASE WHEN push THEN y + uy * CASE WHEN k % 2 = 0 THEN r ELSE -r END END AS y, CASE WHEN push THEN done ELSE list_append(done, {{'i': shot_idx, 'x': x, 'y': y, 'r': r}}) END AS done
  FROM (SELECT *, k < 6 AND len(list_filter(done, lambda d: (x - d.x) * (x - d.x) + (y - d.y) * (y - d.y) < (r + d.r) * (r + d.r))) > 0 AS push FROM pl WHERE x IS NOT NULL)) m LEFT JOIN sb n ON NOT m.push AND n.plan = m.plan AND n.shot_idx = m.shot_idx)"""


@query("q5_place_subjects", f"WITH RECURSIVE {SQL_PLACE} SELECT plan, d.i AS subject_idx, round(d.x, 4) AS px, round(d.y, 4) AS py FROM (SELECT plan, unnest(done) AS d FROM pl WHERE x IS NULL)")
def _(spark, sf):
    return Q.place_subjects(placed_subjects(spark, sf), "plan").select("plan", "subject_idx", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


PARTS = ("Hero", "rival", "sup_3", "guard", "Supplier")


@query("j8_tiered_name_assignment", f"""WITH RECURSIVE {B.LS}, a AS (SELECT plan, shot_idx, l_linenumber, ({list(PARTS)})[l_partkey % 5 + 1] AS role, 'sup_' || (l_suppkey % 7) AS actor FROM ls),
lb AS (SELECT plan, list_sort(list(DISTINCT actor)) AS labels FROM a GROUP BY plan), r0 AS (SELECT plan, role, min(shot_idx) AS first_at, min(CASE WHEN l_linenumber = 7 THEN actor END) AS manual FROM a GROUP BY ALL),
r AS (SELECT r0.plan, role, CASE WHEN list_contains(labels, manual) THEN manual END AS given, labels, row_number() OVER (PARTITION BY r0.plan ORDER BY first_at, role) AS n FROM r0 JOIN lb USING (plan)),
fo AS (SELECT plan, 0::BIGINT AS n, coalesce(list(DISTINCT given) FILTER (WHERE given IS NOT NULL), []::VARCHAR[]) AS taken, 0 AS again, NULL::VARCHAR AS role, NULL::VARCHAR AS actor, NULL::VARCHAR AS how FROM r GROUP BY plan
 UNION ALL SELECT plan, n, list_append(taken, actor), again + CASE WHEN how = 'reused' THEN 1 ELSE 0 END, role, actor, how FROM (SELECT *, CASE how WHEN 'manual' THEN given WHEN 'exact' THEN same[1] WHEN 'contains' THEN part[1] WHEN 'any' THEN free[1] ELSE labels[again % len(labels) + 1] END AS actor FROM (
  SELECT *, CASE WHEN given IS NOT NULL THEN 'manual' WHEN len(same) > 0 THEN 'exact' WHEN len(part) > 0 THEN 'contains' WHEN len(free) > 0 THEN 'any' ELSE 'reused' END AS how FROM (
   SELECT *, list_filter(free, lambda v: lower(v) = lower(role)) AS same, list_filter(free, lambda v: contains(lower(v), lower(role)) OR contains(lower(role), lower(v))) AS part FROM (
    SELECT f.plan, r.n, f.taken, f.again, r.role, r.given, r.labels, list_filter(r.labels, lambda v: NOT list_contains(f.taken, v)) AS free FROM fo f JOIN r ON r.plan = f.plan AND r.n = f.n + 1)))))
SELECT plan, role, actor, how FROM fo WHERE n > 0""")
def _(spark, sf):
    ls = B.order_shots(spark, sf)
    role = F.get(F.array(*[F.lit(x) for x in PARTS]), (F.col("l_partkey") % 5).cast("int"))
    roles = ls.groupBy("plan", role.alias("role")).agg(F.min("shot_idx").alias("first_at"), F.min(F.when(F.col("l_linenumber") == 7, F.concat(F.lit("sup_"), F.col("l_suppkey") % 7))).alias("manual"))
    actors = ls.select("plan", F.concat(F.lit("sup_"), F.col("l_suppkey") % 7).alias("actor"))
    return Q.assign_names(roles, actors, "plan")


def detections(spark, sf):
    """Detections of one frame: up to eight neighbouring vectors, every fourth nearly a copy of the one before."""
    kp = B.keypoints(spark, sf)
    prev = kp.select(F.col("vec_id").alias("near"), F.col("kp").alias("k2"), "bh")
    d = kp.drop("bh").withColumn("near", F.when(F.col("vec_id") % 4 == 1, F.col("vec_id") - 1).otherwise(F.col("vec_id"))).join(prev, "near")
    f = lambda n: F.transform("k2", lambda p: p[n] + F.when(F.col("near") != F.col("vec_id"), 2.0).otherwise(0.0))
    return d.select(F.floor(F.col("vec_id") / 8).alias("frame"), F.col("vec_id").alias("person"), f("x").alias("xs"), f("y").alias("ys"), F.transform("k2", lambda p: p["score"]).alias("scores"),
                    (F.col("bh") * 720).alias("box_height"), F.col("bw").alias("strength"))


SQL_SAME = f"""{B.KP}, d AS (SELECT k.vec_id // 8 AS frame, k.vec_id AS person, k.bw AS strength, list_transform(p.kp, lambda e: {{'x': e.x + CASE WHEN k.vec_id % 4 = 1 THEN 2.0 ELSE 0 END, 'y': e.y + CASE WHEN k.vec_id % 4 = 1 THEN 2.0 ELSE 0 END, 's': e.score}}) AS ps, p.bh * 720 AS h
 FROM kp k JOIN kp p ON p.vec_id = CASE WHEN k.vec_id % 4 = 1 THEN k.vec_id - 1 ELSE k.vec_id END),
g AS (SELECT a.frame, a.person AS ap, b.person AS bp, greatest(a.h, b.h) AS h, list_filter(list_transform(range(1, 18), lambda i: CASE WHEN a.ps[i].s >= 0.5 AND b.ps[i].s >= 0.5 THEN sqrt((a.ps[i].x - b.ps[i].x)**2 + (a.ps[i].y - b.ps[i].y)**2) END), lambda v: v IS NOT NULL) AS gs FROM d a JOIN d b ON a.frame = b.frame AND a.person < b.person),
ed AS (SELECT frame, ap AS a_person, bp AS b_person FROM g WHERE len(gs) >= 3 AND list_median(gs) <= 0.08 * h)"""


@query("j16_duplicate_edges", f"WITH {SQL_SAME} SELECT frame, a_person, b_person FROM ed")
def _(spark, sf):
    return Q.duplicate_edges(detections(spark, sf), ["frame"])


@query("j16_duplicate_person_join", f"""WITH RECURSIVE {SQL_SAME}, nb AS (SELECT frame, p, list(q) AS near FROM (SELECT frame, a_person AS p, b_person AS q FROM ed UNION ALL SELECT frame, b_person, a_person FROM ed) GROUP BY ALL),
li AS (SELECT d.frame, person, coalesce(near, []::BIGINT[]) AS near, row_number() OVER (PARTITION BY d.frame ORDER BY strength DESC, person) AS n FROM d LEFT JOIN nb ON nb.frame = d.frame AND nb.p = d.person),
kp2 AS (SELECT DISTINCT frame, 0::BIGINT AS n, NULL::BIGINT AS person, NULL::BOOLEAN AS kept, []::BIGINT[] AS held FROM li
 UNION ALL SELECT frame, n, person, kept, CASE WHEN kept THEN list_append(held, person) ELSE held END FROM (SELECT li.frame, li.n, li.person, k.held, len(list_filter(li.near, lambda v: list_contains(k.held, v))) = 0 AS kept FROM kp2 k JOIN li ON li.frame = k.frame AND li.n = k.n + 1))
SELECT frame, person, kept FROM kp2 WHERE n > 0""")
def _(spark, sf):
    return Q.drop_duplicate_people(detections(spark, sf), ["frame"])


def _minor(rows, cols, at) -> str:
    (a, b, c), (d, e, f) = rows, cols
    return (f"({at(a, d)} * ({at(b, e)} * {at(c, f)} - {at(b, f)} * {at(c, e)}) - {at(a, e)} * ({at(b, d)} * {at(c, f)} - {at(b, f)} * {at(c, d)})"
            f" + {at(a, f)} * ({at(b, d)} * {at(c, e)} - {at(b, e)} * {at(c, d)}))")


def _others(i: int) -> list[int]:
    return [k for k in range(4) if k != i]


def _n(i: int, j: int) -> str:
    return f"n{min(i, j)}{max(i, j)}"


def _shifted(i: int, j: int) -> str:
    return f"({_n(i, j)} - lam)" if i == j else _n(i, j)


# the quaternion comes from the column of the adjoint of (N - largest eigenvalue) with the longest diagonal cofactor
SQL_TURN = f"""{B.PO}, mp AS (SELECT unnest({list(MIRROR)}) AS role, unnest({list(MIRROR.values())}) AS flipped), va AS (SELECT 'd' AS variant, role, role AS bone FROM mp UNION ALL SELECT 'm', role, flipped FROM mp),
pt AS (SELECT t.pair, t.sample, variant, t.x, t.y, t.z, s.x AS tx, s.y AS ty, s.z AS tz FROM po t JOIN va ON va.role = t.role JOIN po s ON s.pair = t.pair AND s.sample = t.sample AND s.side = 's' AND s.role = va.bone WHERE t.side = 't'),
aw AS (SELECT pair, sample, variant, {', '.join(f'{c} - avg({c}) OVER w AS {c}' for c in ('x', 'y', 'z', 'tx', 'ty', 'tz'))}, count(*) OVER w AS cnt FROM pt WINDOW w AS (PARTITION BY pair, sample, variant)),
su AS (SELECT pair, sample, variant, sum(x*x + y*y + z*z) AS gg, sum(tx*tx + ty*ty + tz*tz) AS tt, {', '.join(f'sum({p} * t{q}) AS s{p}{q}' for p in 'xyz' for q in 'xyz')} FROM aw WHERE cnt >= 8 GROUP BY ALL),
nn AS (SELECT *, sxx + syy + szz AS n00, syz - szy AS n01, szx - sxz AS n02, sxy - syx AS n03, sxx - syy - szz AS n11, sxy + syx AS n12, szx + sxz AS n13, syy - sxx - szz AS n22, syz + szy AS n23, szz - sxx - syy AS n33 FROM su),
cf AS (SELECT *, -2 * ({' + '.join(f's{p}{q} * s{p}{q}' for p in 'xyz' for q in 'xyz')}) AS c2, -8 * (sxx * (syy * szz - syz * szy) - sxy * (syx * szz - syz * szx) + sxz * (syx * szy - syy * szx)) AS c1,
 {' + '.join(f'({(-1) ** j}) * {_n(0, j)} * {_minor(_others(0), _others(j), _n)}' for j in range(4))} AS c0 FROM nn),
nw AS (SELECT pair, sample, variant, 0 AS it, sqrt(gg * tt) AS lam FROM cf UNION ALL SELECT nw.pair, nw.sample, nw.variant, it + 1, CASE WHEN (4 * lam * lam + 2 * c2) * lam + c1 > 0 THEN lam - (((lam * lam + c2) * lam + c1) * lam + c0) / ((4 * lam * lam + 2 * c2) * lam + c1) ELSE lam END
 FROM nw JOIN cf USING (pair, sample, variant) WHERE it < 60),
ad AS (SELECT cf.*, lam, {', '.join(f'({(-1) ** (i + j)}) * {_minor(_others(i), _others(j), _shifted)} AS a{i}{j}' for i in range(4) for j in range(4))} FROM cf JOIN nw USING (pair, sample, variant) WHERE it = 60),
qt AS (SELECT pair, sample, variant, lam / gg AS grow, list_transform(q, lambda v: v / sqrt(list_sum(list_transform(q, lambda u: u * u)))) AS q FROM (SELECT *, CASE greatest(abs(a00), abs(a11), abs(a22), abs(a33)) WHEN abs(a00) THEN [a00, a01, a02, a03] WHEN abs(a11) THEN [a10, a11, a12, a13] WHEN abs(a22) THEN [a20, a21, a22, a23] ELSE [a30, a31, a32, a33] END AS q FROM ad)),
ro AS (SELECT aw.*, grow, q[1] AS w, q[2] AS i, q[3] AS j, q[4] AS k FROM aw JOIN qt USING (pair, sample, variant)),
le AS (SELECT pair, sample, variant, sqrt((tx - grow * ((1 - 2*(j*j + k*k)) * x + 2*(i*j - k*w) * y + 2*(i*k + j*w) * z))**2 + (ty - grow * (2*(i*j + k*w) * x + (1 - 2*(i*i + k*k)) * y + 2*(j*k - i*w) * z))**2 + (tz - grow * (2*(i*k - j*w) * x + 2*(j*k + i*w) * y + (1 - 2*(i*i + j*j)) * z))**2) AS e FROM ro)"""


@query("a27_procrustes_error", f"WITH RECURSIVE {SQL_TURN} SELECT pair, sample, round(min(e), 5) AS error FROM (SELECT pair, sample, variant, avg(e) AS e FROM le GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    po = B.poses(spark, sf)
    truth = po.where("side = 's'").select("pair", "sample", "role", *[F.col(c).alias(f"t{c}") for c in "xyz"])
    maps = F.array(F.struct(F.lit("direct").alias("variant"), F.col("role").alias("to")), F.struct(F.lit("mirrored").alias("variant"), B.literal_map(MIRROR)[F.col("role")].alias("to")))
    guess = po.where("side = 't'").where(F.col("role").isin(list(MIRROR))).select("pair", "sample", "x", "y", "z", F.inline(maps)).withColumnRenamed("to", "role")
    out = Q.procrustes_error(guess.join(truth, ["pair", "sample", "role"]), ["pair", "sample"])
    return out.withColumn("error", F.round("error", 5))


EXPECT = [("click", 8), ("view", 7), ("signup", None), ("error", 46), ("none", None), ("purchase", 5)]


@query("a36_search_scorecard", f"""WITH g AS (SELECT event_type AS prompt, user_id AS video, round(avg(value), 6) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, video) AS rank FROM g),
e AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {v if v is not None else 'NULL'})" for p, v in EXPECT)}) t(prompt, video))
SELECT e.prompt, e.video::BIGINT AS video, r.video AS found, CASE WHEN e.video IS NULL THEN r.video IS NULL OR r.score < 40 ELSE coalesce(e.video = r.video, false) END AS passed FROM e LEFT JOIN r ON r.prompt = e.prompt AND r.rank = 1""")
def _(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("prompt"), F.col("user_id").alias("video")).agg(r6(F.avg("value")).alias("score"))
    top = g.groupBy("prompt").agg(F.min(F.struct((-F.col("score")).alias("s"), "video")).alias("m")).select("prompt", F.lit(1).alias("rank"), "m.video", (-F.col("m.s")).alias("score"))
    return SC.search_scorecard(top, spark.createDataFrame(EXPECT, "prompt string, video bigint"))
