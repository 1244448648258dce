"""Ordered operators over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import boundaries as BD
from framewise.operators import windows as W
from framewise.plans import bindings as B
from framewise.plans.q_functions import LK, LINE_KEYS, SQL_LINES, lines, r6
from framewise.plans.registry import query, table

SQL_CHANGE = B.FR + """, ch AS (SELECT clip, frame, least(1.0, list_sum(list_transform(range(1, 65), lambda i: abs(sig[i] - p[i]))) / 64) AS change
 FROM (SELECT clip, frame, sig, lag(sig) OVER (PARTITION BY clip ORDER BY frame) AS p FROM fr))"""


@query("w1_change_score", f"WITH {SQL_CHANGE} SELECT clip, frame, round(change, 6) AS change FROM ch")
def _(spark, sf):
    return W.change_score(B.frames(spark, sf), ["clip"]).select("clip", "frame", r6(F.col("change")).alias("change"))


@query("w2_detect_boundaries", "WITH RECURSIVE " + SQL_CHANGE + """,
bd AS (SELECT clip, frame, 1.0::DOUBLE AS score FROM ch WHERE frame = 0
 UNION ALL
 SELECT clip, frame, change FROM (SELECT ch.clip, ch.frame, ch.change, row_number() OVER (PARTITION BY ch.clip ORDER BY ch.frame) AS rn
  FROM bd JOIN ch ON ch.clip = bd.clip AND ch.frame - bd.frame >= 3 AND ch.change >= 0.142) WHERE rn = 1)
SELECT clip, frame, round(score, 6) AS score FROM bd""")
def _(spark, sf):
    ch = W.change_score(B.frames(spark, sf), ["clip"]).withColumn("time", F.col("frame").cast("double"))
    bd = BD.detect_boundaries(ch, ["clip"], 0.142, 3.0)
    return bd.select("clip", "frame", r6(F.col("score")).alias("score"))


def cut_matches(spark, sf):
    """Event shots with a stand-in match across each cut."""
    es = B.event_shots(spark, sf)
    return es.withColumns({"inlier": 0.5 + F.col("confidence"), "tx": F.col("people") * 0.03, "ty": F.lit(0.01),
                           "scale": F.when(F.col("size") == "wide", 1.1).otherwise(1.0),
                           "content": F.col("confidence") * 20})


@query("w3_merge_false_cuts", f"""WITH {B.ES}, f AS (SELECT *, CASE WHEN shot_idx > 0 AND 0.5 + confidence >= 0.6 AND people * 0.03 < 0.08
 AND size <> 'wide' AND confidence * 20 <= 8 THEN 0 ELSE 1 END AS fresh FROM es),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY reel ORDER BY shot_idx)::BIGINT AS island FROM f)
SELECT reel, island, min("start") AS "start", max("end") AS "end", count(*) - 1 AS merged FROM i GROUP BY reel, island""")
def _(spark, sf):
    return W.merge_false_cuts(cut_matches(spark, sf), ["reel"])


SQL_MERGE_EDGE = """RECURSIVE {shots},
sq AS (SELECT reel, list(struct_pack(s := "start", e := "end", m := 0) ORDER BY shot_idx) AS l FROM es GROUP BY reel),
tl AS (SELECT reel, l, 0 AS done FROM sq UNION ALL
 SELECT reel, CASE WHEN len(l) > 1 AND l[-1].e - l[-1].s < {m} THEN list_append(l[1:len(l)-2], struct_pack(s := l[-2].s, e := l[-1].e, m := l[-2].m + l[-1].m + 1)) ELSE l END,
  CASE WHEN len(l) > 1 AND l[-1].e - l[-1].s < {m} THEN 0 ELSE 1 END FROM tl WHERE done = 0),
hd AS (SELECT reel, l, 0 AS done FROM tl WHERE done = 1 UNION ALL
 SELECT reel, CASE WHEN len(l) > 1 AND l[1].e - l[1].s < {m} THEN list_prepend(struct_pack(s := l[1].s, e := l[2].e, m := l[1].m + l[2].m + 1), l[3:]) ELSE l END,
  CASE WHEN len(l) > 1 AND l[1].e - l[1].s < {m} THEN 0 ELSE 1 END FROM hd WHERE done = 0)
SELECT reel, x.s AS "start", x.e AS "end", x.m::BIGINT AS merged FROM (SELECT reel, unnest(l) AS x FROM hd WHERE done = 1)"""


@query("w4_merge_edge_fragments", "WITH " + SQL_MERGE_EDGE.format(shots=B.ES, m=40000))
def _(spark, sf):
    return W.merge_edge_fragments(B.event_shots(spark, sf), ["reel"], 40000.0)


@query("f11_drop_short_shots", f"""WITH {B.ES}, k AS (SELECT reel, "start", "end" FROM es WHERE "end" - "start" > 120000),
v AS (SELECT reel, max("end") AS duration FROM es GROUP BY reel)
SELECT * FROM k UNION ALL SELECT reel, 0.0::DOUBLE, duration FROM v WHERE reel NOT IN (SELECT reel FROM k)""")
def _(spark, sf):
    es = B.event_shots(spark, sf)
    return W.drop_short_shots(es, es.groupBy("reel").agg(F.max("end").alias("duration")), ["reel"], 120000.0)


@query("w5_sample_times", f"""WITH s AS (SELECT {LK}, l_extendedprice / 1000 AS st, l_extendedprice / 1000 + l_quantity / 25 AS en FROM lineitem),
m AS (SELECT *, en - st AS len, least((en - st) * 0.1, 0.25) AS mg FROM s)
SELECT {LK}, 'people' AS kind, i::INT AS sample, round(st + mg + (len - 2*mg) * (i / 3), 6) AS "time" FROM m, range(0, 4) r(i) WHERE len > 0.4
UNION ALL SELECT {LK}, 'people', 0, round(st + len / 2, 6) FROM m WHERE len <= 0.4
UNION ALL SELECT {LK}, 'motion', i::INT, round(st + mg + (len - 2*mg) * (i / 7), 6) FROM m, range(0, 8) r(i) WHERE len > 0.8""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *LINE_KEYS, (F.col("l_extendedprice") / 1000).alias("start"),
        (F.col("l_extendedprice") / 1000 + F.col("l_quantity") / 25).alias("end"))
    return W.sample_times(li).withColumn("time", r6(F.col("time"))).drop("start", "end")


@query("w6_frame_budget", f"""WITH {B.ES}, b AS (SELECT reel, floor("start" / 9000)::BIGINT AS start_frame FROM es GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY reel ORDER BY start_frame) - 1 AS i, count(*) OVER (PARTITION BY reel) AS n,
 coalesce(greatest(start_frame, lead(start_frame) OVER (PARTITION BY reel ORDER BY start_frame) - 1), 320) AS e FROM b),
many AS (SELECT reel, start_frame AS frame FROM n WHERE n > 60 AND i IN (SELECT floor(j * (n - 1) / 59 + 0.5) FROM range(0, 60) r(j))),
cand AS (SELECT reel, i, 0 AS p, start_frame AS frame FROM n WHERE n <= 60 UNION ALL SELECT reel, i, 1, floor((start_frame + e) * 0.5 + 0.5)::BIGINT FROM n WHERE n <= 60
 UNION ALL SELECT reel, i, 2, e FROM n WHERE n <= 60),
firsts AS (SELECT reel, frame, min((p, i)) AS k FROM cand GROUP BY ALL)
SELECT reel, frame FROM many UNION ALL SELECT reel, frame FROM firsts QUALIFY row_number() OVER (PARTITION BY reel ORDER BY k) <= 60""")
def _(spark, sf):
    es = B.event_shots(spark, sf)
    starts = es.select("reel", F.floor(F.col("start") / 9000).alias("start_frame"), F.lit(321).alias("n_frames")).distinct()
    return W.frame_budget(starts, ["reel"], "n_frames", 60)


@query("w7_timeline_layout", f"""WITH {B.LS}, f AS (SELECT *, greatest(1, floor(l_quantity / 10 * 30 + 0.5))::BIGINT AS n FROM ls)
SELECT plan, shot_idx, coalesce(sum(n) OVER (PARTITION BY plan ORDER BY shot_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame,
 sum(n) OVER (PARTITION BY plan ORDER BY shot_idx)::BIGINT AS end_frame FROM f""")
def _(spark, sf):
    ls = B.order_shots(spark, sf).withColumn("duration", F.col("l_quantity") / 10)
    return W.timeline_layout(ls, ["plan"], "duration", 30.0).select("plan", "shot_idx", "start_frame", "end_frame")


KEYED = {"x": "l_quantity", "y": "l_discount * 100", "z": "l_tax * 100", "roll": "l_linenumber * 1.0", "pitch": "l_discount * 50",
         "yaw": "l_tax * 200"}
JITTER = {"x": "sin({p}) * 3.5", "y": "cos({p} * 1.31) * 5.0", "z": "sin({p} * 0.83) * 2.5", "pitch": "sin({p} * 1.47) * 0.7",
          "yaw": "cos({p} * 0.91) * 1.1", "roll": "sin({p} * 1.73) * 0.45"}


@query("w8_keyframe_expand", f"""WITH {SQL_LINES}, s AS (SELECT *, l_linenumber * 10::BIGINT AS sf, (l_linenumber * 10 + 3 + l_quantity)::BIGINT AS ef,
 lens * CASE WHEN motion = 'zoom_in' THEN 1.45 ELSE 0.72 END AS lens1 FROM li)
SELECT {LK}, sf AS frame, {', '.join(f'round({v}, 6) AS {k}' for k, v in KEYED.items())}, CASE WHEN motion IN ('zoom_in', 'zoom_out') THEN round(lens, 6) END AS lens FROM s
UNION ALL SELECT {LK}, greatest(sf, ef - 1), {', '.join(f'round(({v}) * 1.5 + 2, 6)' for v in KEYED.values())}, CASE WHEN motion IN ('zoom_in', 'zoom_out') THEN round(lens1, 6) END FROM s
UNION ALL SELECT {LK}, floor(sf + (ef - 1 - sf) * (i / 6.0) + 0.5)::BIGINT,
 {', '.join(f'round(({v}) + (({v}) * 1.5 + 2 - ({v})) * (i / 6.0) + ' + JITTER[k].format(p='(i * 2.17)') + ', 6)' for k, v in KEYED.items())}, NULL
FROM s, range(1, 6) r(i) WHERE motion = 'handheld' AND ef - sf >= 6""")
def _(spark, sf):
    li = lines(spark, sf)
    start = F.col("l_linenumber").cast("bigint") * 10
    shots = li.select(*LINE_KEYS, "motion", start.alias("start_frame"),
                      (start + 3 + F.col("l_quantity").cast("bigint")).alias("end_frame"),
                      *[F.expr(v).alias(f"{k}0") for k, v in KEYED.items()],
                      *[(F.expr(v) * 1.5 + 2).alias(f"{k}1") for k, v in KEYED.items()],
                      F.col("lens").alias("lens0"),
                      (F.col("lens") * F.when(F.col("motion") == "zoom_in", 1.45).otherwise(0.72)).alias("lens1"))
    out = W.keyframe_expand(shots)
    return out.select(*LINE_KEYS, "frame", *[r6(F.col(c)).alias(c) for c in [*W.CHANNELS, "lens"]])


@query("w9_rebase_time", f"""WITH {B.ES}, m AS (SELECT reel, shot_idx, floor("start" * 1000) / 1000 AS s, floor("end" * 1000) / 1000 AS e FROM es),
o AS (SELECT *, first_value(s) OVER (PARTITION BY reel ORDER BY shot_idx) AS origin FROM m)
SELECT reel, shot_idx, round(s - origin, 3) AS "start", round(e - origin, 3) AS "end" FROM o""")
def _(spark, sf):
    es = B.event_shots(spark, sf).withColumns({c: F.floor(F.col(c) * 1000) / 1000 for c in ("start", "end")})
    return W.rebase_time(es, ["reel"]).select("reel", "shot_idx", "start", "end")


@query("w10_people_rank", f"""WITH {B.LS}, k AS (SELECT plan, shot_idx, row_number() OVER (PARTITION BY plan ORDER BY l_extendedprice * least(1.0, l_discount * 10 / 0.6) DESC, shot_idx) - 1 AS d FROM ls)
SELECT plan, shot_idx, d::INT AS depth_order, CASE WHEN d = 0 THEN 'main_character' ELSE 'character_' || (d + 1) END AS role FROM k WHERE d < 4""")
def _(spark, sf):
    ls = B.order_shots(spark, sf).withColumn("score", F.col("l_discount") * 10)
    return W.people_rank(ls, ["plan"], "l_extendedprice", "score", "shot_idx").select("plan", "shot_idx", "depth_order", "role")


@query("w11_track_reversals", f"""WITH {B.EV}, a AS (SELECT reel, i, (value - 40) / 1000 AS tx, lag((value - 40) / 1000) OVER (PARTITION BY reel ORDER BY i) AS p FROM ev)
SELECT reel, count(*) FILTER (WHERE tx * p < 0 AND abs(tx) > 0.004 AND abs(p) > 0.004) AS reversals FROM a GROUP BY reel""")
def _(spark, sf):
    ev = B.event_series(spark, sf).select("reel", (F.col("i") - 1).alias("i"), ((F.col("value") - 40) / 1000).alias("tx"))
    return W.reversals(ev, ["reel"], "tx")


@query("t2_pick_best_format", """WITH f AS (SELECT l_suppkey, l_quantity * 30 AS w, l_discount * 12000 + 60 AS h, ([NULL, 'none', 'avc1.4d', 'VP9', 'av01', 'h264'])[l_partkey % 6 + 1] AS vcodec,
 CASE WHEN l_linenumber > 4 THEN 'm3u8_native' ELSE 'https' END AS protocol, l_extendedprice AS tbr, l_orderkey::VARCHAR AS format_id FROM lineitem),
c AS (SELECT *, lower(coalesce(vcodec, '')) AS v, least(w, h) AS short_side FROM f)
SELECT l_suppkey, b.format_id AS format_id, b.s AS short_side FROM (SELECT l_suppkey, max({'a': regexp_matches(v, '^(avc|h264|vp9|vp09)'), 's': short_side,
 'b': regexp_matches(v, '^(avc|h264)'), 'p': NOT contains(protocol, 'm3u8'), 't': tbr, 'format_id': format_id}) AS b FROM c WHERE v NOT IN ('', 'none') AND short_side <= 720 GROUP BY l_suppkey)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    codecs = F.array(F.lit(None).cast("string"), *[F.lit(c) for c in ["none", "avc1.4d", "VP9", "av01", "h264"]])
    fm = li.select("l_suppkey", (F.col("l_quantity") * 30).alias("width"), (F.col("l_discount") * 12000 + 60).alias("height"),
                   F.get(codecs, (F.col("l_partkey") % 6).cast("int")).alias("vcodec"),
                   F.when(F.col("l_linenumber") > 4, "m3u8_native").otherwise("https").alias("protocol"),
                   F.col("l_extendedprice").alias("tbr"), F.col("l_orderkey").alias("format_id"))
    return W.pick_best_format(fm, ["l_suppkey"], 720)


@query("t3_review_top_n", """WITH f AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_discount > 0.07),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS rank, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM f)
SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey, l_extendedprice, rank::INT AS rank, greatest(n - 5, 0) AS hidden FROM r WHERE rank <= 5""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_partkey", "l_extendedprice",
                                             (F.col("l_discount") > 0.07).alias("needs_review"))
    return W.review_top(li, ["l_returnflag", "l_linestatus"],
                        [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey")]).drop("needs_review")


@query("t4_largest_candidate", f"""WITH {B.LS} SELECT plan, arg_max(shot_idx, {{'a': l_quantity * l_discount, 'i': -shot_idx}}) AS shot_idx, round(max(l_quantity * l_discount), 6) AS area FROM ls GROUP BY plan""")
def _(spark, sf):
    ls = B.order_shots(spark, sf).withColumn("area", F.col("l_quantity") * F.col("l_discount"))
    return ls.groupBy("plan").agg(F.max_by("shot_idx", F.struct("area", -F.col("shot_idx"))).alias("shot_idx"),
                                  r6(F.max("area")).alias("area"))


@query("u1_union_entries", """SELECT 'clip_' || doc_id || '.mp4' AS path, source, NULL AS url FROM documents UNION ALL SELECT 'link:' || page_id, NULL, url FROM pages""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("clip_"), "doc_id", F.lit(".mp4")).alias("path"), "source")
    p = table(spark, sf, "pages").select(F.concat(F.lit("link:"), "page_id").alias("path"), "url")
    return d.unionByName(p, allowMissingColumns=True)


@query("u2_shared_roles", """SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O'
INTERSECT SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F'""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).select("l_suppkey", "l_returnflag")
    return side("O").intersect(side("F"))


@query("u3_ordered_distinct", "SELECT conv_id, role, min(turn) AS first_at FROM conversations GROUP BY conv_id, role")
def _(spark, sf):
    return W.ordered_distinct(table(spark, sf, "conversations"), ["conv_id"], "role", "turn")


@query("u4_unused_items", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(used, "o_orderkey", "left_anti")
