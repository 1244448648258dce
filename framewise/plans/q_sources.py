"""Listings, documents, sinks and stream jobs over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.plans import bindings as B
from framewise.plans.q_functions import r6
from framewise.plans.q_metrics import SQL_QUALITY, quality
from framewise.plans.q_windows import SQL_CHANGE
from framewise.plans.registry import query, table
from framewise.sources import tables as ST
from framewise.streaming import jobs

MEDIA = "CASE doc_id % 6 WHEN 0 THEN source || '/Clip_' || doc_id || '.MP4' WHEN 1 THEN source || '/a.b/' || doc_id || '.webm' WHEN 2 THEN source || '/.framewise/plans/' || doc_id || '.mp4' WHEN 3 THEN '.framewise/' || doc_id || '.mov' WHEN 4 THEN source || '/notes_' || doc_id || '.txt' ELSE source || '/' || doc_id || '.m4v' END"


@query("s1_scan_media_listing", f"SELECT path, n_chars FROM (SELECT {MEDIA} AS path, n_chars, doc_id FROM documents) WHERE doc_id % 6 IN (0, 1, 5)")
def _(spark, sf):
    files = table(spark, sf, "documents").select(F.expr(MEDIA).alias("path"), "n_chars")
    return ST.media_listing(files)


PATTERNS = ["{dataset}_2[0-9]*$", "{dataset}_old_.*"]


@query("s4_latest_dataset", """WITH f AS (SELECT source AS dataset, source || CASE WHEN doc_id % 2 = 0 AND source <> 'src4' THEN '_2' || (doc_id % 1000) WHEN doc_id % 3 = 0 THEN '_old_' || doc_id ELSE '_x' || doc_id END AS path FROM documents),
g AS (SELECT dataset, path, CASE WHEN regexp_matches(substr(path, len(dataset) + 1), '^_2[0-9]*$') THEN 0 WHEN contains(path, '_old_') THEN 1 END AS rk FROM f) SELECT dataset, path FROM g WHERE rk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY rk, path DESC) = 1""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    tail = (F.when((k % 2 == 0) & (F.col("source") != "src4"), F.concat(F.lit("_2"), k % 1000)).when(k % 3 == 0, F.concat(F.lit("_old_"), k)).otherwise(F.concat(F.lit("_x"), k)))
    return ST.latest_dataset(d.select(F.col("source").alias("dataset"), F.concat("source", tail).alias("path")), PATTERNS)


def pose_docs(spark, sf):
    """One document per pair, from the long pose rows."""
    bones = B.poses(spark, sf).groupBy("pair", "side", "sample").agg(F.map_from_entries(F.collect_list(F.struct("role", F.array("x", "y", "z").alias("v")))).alias("bones"))
    tw = B.twists(spark, sf).groupBy("pair", "side", "sample").agg(F.map_from_entries(F.collect_list(F.struct("role", "q"))).alias("twist"))
    f = bones.join(tw, ["pair", "side", "sample"], "left")
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("sample", F.to_json(F.struct((F.col("sample") / 24).alias("time"), "bones", "twist")).alias("j"))))), lambda x: x["j"])
    g = f.groupBy("pair").agg(side("s").alias("s"), side("t").alias("t"))
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    return g.select(F.concat(F.lit('{"name":"'), "pair", F.lit('","source_frames":'), text("s"), F.lit(',"target_frames":'), text("t"), F.lit("}")).alias("doc"))


@query("s5_read_pose_pairs", f"WITH {B.PO} SELECT pair::VARCHAR AS pair, side, sample, role, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM po")
def _(spark, sf):
    return ST.read_pose_pairs(pose_docs(spark, sf))[0].withColumns({c: r6(F.col(c)) for c in "xyz"})


@query("s5_read_pose_twists", f"WITH {B.TW} SELECT pair::VARCHAR AS pair, side, sample, role, round(q[1], 6) AS q1, round(q[4], 6) AS q4 FROM tw")
def _(spark, sf):
    t = ST.read_pose_pairs(pose_docs(spark, sf))[1]
    return t.select("pair", "side", "sample", "role", r6(F.get("q", F.lit(0))).alias("q1"), r6(F.get("q", F.lit(3))).alias("q4"))


@query("s6_read_curve_tables", f"""WITH {B.EV}, f AS (SELECT reel || '_' || floor(t / 86400)::BIGINT AS name, row_number() OVER (PARTITION BY reel, floor(t / 86400) ORDER BY i) - 1 AS frame, event_type, value FROM ev), c AS (SELECT DISTINCT name, event_type AS curve FROM f)
SELECT f.name, f.frame, round(f.frame / 24, 6) AS "time", c.curve, CASE WHEN f.event_type = c.curve THEN f.value ELSE 0.0 END AS value FROM f JOIN c USING (name)""")
def _(spark, sf):
    ev = B.event_series(spark, sf).withColumn("name", F.concat_ws("_", "reel", F.floor(F.col("t") / 86400)))
    g = ev.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "event_type", "value"))).alias("v"), F.array_sort(F.collect_set("event_type")).alias("curve_names"))
    doc = F.to_json(F.struct(F.col("name").alias("performance"), F.lit(24.0).alias("frame_rate"), "curve_names",
                             F.transform("v", lambda e: F.create_map(e["event_type"], e["value"])).alias("values")))
    return ST.read_curve_tables(g.select(doc.alias("doc"))).withColumn("time", r6(F.col("time")))


@query("s7_read_link_analyses", """WITH p AS (SELECT page_id, page_id % 4 AS n, page_id % 11 = 0 AS bad, url FROM pages), s AS (SELECT doc_id, doc_id % 7 = 0 AS bad, CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' T' || doc_id || ' ' END AS title, doc_id % 5 = 0 AS kept FROM documents)
SELECT 'f' || page_id AS folder, 'link:' || t AS path, t AS title, url, n::INT AS n_shots, CASE WHEN page_id % 2 = 0 THEN (page_id % 4)::INT END AS identities, kept AS video_retained FROM (SELECT *, trim(CASE WHEN title <> '' THEN title WHEN page_id % 9 = 0 THEN 'f' || page_id ELSE 'Plan' || page_id END) AS t FROM p JOIN s ON s.doc_id = p.page_id WHERE NOT p.bad AND NOT s.bad AND n > 0)""")
def _(spark, sf):
    k = F.col("page_id")
    shots = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (k % 4).cast("int"))
    plan = F.to_json(F.struct(F.when(k % 9 != 0, F.concat(F.lit("Plan"), k)).alias("title"), shots.alias("shots"),
                              F.when(k % 2 == 0, F.struct(F.struct((k % 4).alias("count")).alias("identities"))).alias("analysis_notes")))
    pages = table(spark, sf, "pages")
    p = pages.select(F.concat(F.lit("f"), k).alias("folder"), F.when(k % 11 == 0, F.lit("{broken")).otherwise(plan).alias("doc"))
    d = F.col("doc_id")
    src = F.to_json(F.struct(F.when(d % 3 == 0, "").otherwise(F.concat(F.lit(" T"), d, F.lit(" "))).alias("title"), (d % 5 == 0).alias("video_retained"), "url"))
    docs = table(spark, sf, "documents").join(pages.select(k.alias("doc_id"), "url"), "doc_id")
    s = docs.select(F.concat(F.lit("f"), d).alias("folder"), F.when(d % 7 == 0, F.lit("nope")).otherwise(src).alias("doc"))
    return ST.read_link_analyses(p, s)


@query("k2_quality_report_header", f"WITH {SQL_QUALITY} SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(segments_compared, 0) > 0) AS measured, count(*) FILTER (WHERE len(reasons) > 0) AS review FROM qf")
def _(spark, sf):
    """A run is appended to the reports, and its header comes from what was written."""
    path = f"{jobs.work_folder(spark)}/reports"
    rows = quality(spark, sf)
    run = ST.write_quality_report(rows, path)
    return ST.report_header(spark.read.parquet(path).where(F.col("run_id") == run))


@query("k5_quality_summary", f"""WITH {SQL_QUALITY}, n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(segments_compared, 0) > 0) AS measured, count(*) FILTER (WHERE len(reasons) > 0) AS review FROM qf)
SELECT printf('Quality check: %d of %d measured need a review', review, measured) || CASE WHEN rows > measured THEN printf(' (%d could not be measured for missing roles)', rows - measured) ELSE '' END AS text FROM n""")
def _(spark, sf):
    return ST.quality_summary(quality(spark, sf))


@query("k5_context_lists", """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem),
c AS (SELECT l_orderkey, printf('- label=sup_%d; class=Part%d; location=(%.1f,%.1f,%.1f)', l_suppkey, l_partkey % 7, l_quantity, -l_quantity, 0.5) AS line FROM lineitem WHERE l_linenumber % 2 = 0
 UNION ALL SELECT l_orderkey, printf('- id=a%d; type=%s; name=N%d; duration=%.2fs', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'animation' ELSE 'audio' END, l_suppkey, l_quantity / 4) FROM lineitem WHERE l_linenumber % 3 = 0)
SELECT o.l_orderkey, coalesce(string_agg(line, chr(10) ORDER BY line), 'none') AS text FROM o LEFT JOIN c USING (l_orderkey) GROUP BY o.l_orderkey""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    named = lambda word, c: F.concat(F.lit(word), c)
    actors = li.where("l_linenumber % 2 = 0").select("l_orderkey", ST.actor_line(
        named("sup_", F.col("l_suppkey")), named("Part", F.col("l_partkey") % 7), F.col("l_quantity"), -F.col("l_quantity"), F.lit(0.5)).alias("line"))
    assets = li.where("l_linenumber % 3 = 0").select("l_orderkey", ST.asset_line(
        named("a", F.col("l_partkey")), F.when(F.col("l_partkey") % 2 == 0, "animation").otherwise("audio"), named("N", F.col("l_suppkey")), F.col("l_quantity") / 4).alias("line"))
    return ST.context_text(li.select("l_orderkey").distinct(), actors.unionByName(assets), ["l_orderkey"], "line")


@query("k4_library_index", f"WITH {B.ES} SELECT 'clip_' || reel || '.mp4' AS path, count(*) AS n_shots, max(people) AS identities, 1 AS version, 'a:1' AS analyzer FROM es GROUP BY reel")
def _(spark, sf):
    g = B.event_shots(spark, sf).groupBy("reel").agg(F.count(F.lit(1)).alias("n_shots"), F.max("people").alias("identities"))
    entries = g.select(F.concat(F.lit("clip_"), "reel", F.lit(".mp4")).alias("path"), "n_shots", "identities")
    folder = jobs.work_folder(spark)
    ST.write_library_index(entries, entries.where("n_shots = 0").select("path", F.lit("empty").alias("error")), folder, "a:1")
    return ST.read_library_index(spark, folder, "path string, n_shots bigint, identities int, version int, analyzer string")


@query("k5_render_text_report", f"""WITH {B.ES} SELECT reel, shot_idx, printf('%02d  %.2f-%.2fs  %s | role=%s | %s / %s / %s | confidence %.0f%%', (shot_idx + 1)::INT, (floor("start") / 4)::DOUBLE, (floor("end") / 4)::DOUBLE, name, CASE WHEN people = 1 THEN 'solo' ELSE 'main' END, size, angle, motion, floor(confidence * 100 + 0.5)::DOUBLE) AS line FROM es""")
def _(spark, sf):
    es = B.event_shots(spark, sf)
    s = es.select("reel", "shot_idx", (F.floor("start") / 4).alias("start_seconds"), (F.floor("end") / 4).alias("end_seconds"), "name", F.when(F.col("people") == 1, "solo").otherwise("main").alias("subject_role"),
                  F.col("size").alias("shot_size"), F.col("angle").alias("camera_angle"), F.col("motion").alias("camera_motion"), "confidence")
    return s.select("reel", "shot_idx", ST.shot_line(F.col("shot_idx").cast("int")).alias("line"))


@query("k5_verify_report", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN 'shot' || l_linenumber || ': no_person' ELSE printf('%s: score %.0f | dx %+.3f dy %+.3f | size x%.2f', 'shot' || l_linenumber, l_quantity, l_discount, -l_tax, l_discount * 10) END AS line FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("shot"), "l_linenumber").alias("name"), F.when(F.col("l_tax") == 0, "no_person").otherwise("ok").alias("status"),
        F.col("l_quantity").alias("score"), (F.col("l_discount") + 0.0).alias("error_x"), (-F.col("l_tax")).alias("error_y"), (F.col("l_discount") * 10).alias("height_ratio"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ST.verify_line().alias("line"))


@query("st1_stream_boundaries", "WITH RECURSIVE " + SQL_CHANGE + """, cv AS (SELECT ch.clip, fr.vec_id AS t, ch.frame, ch.change FROM ch JOIN fr USING (clip, frame)),
bd AS (SELECT clip, t, 1.0::DOUBLE AS score FROM cv WHERE frame = 0
 UNION ALL SELECT clip, t, change FROM (SELECT cv.clip, cv.t, cv.change, row_number() OVER (PARTITION BY cv.clip ORDER BY cv.t) AS rn FROM bd JOIN cv ON cv.clip = bd.clip AND cv.t - bd.t >= 30 AND cv.change >= 0.142) WHERE rn = 1)
SELECT clip, t::DOUBLE AS "time", round(score, 6) AS score FROM bd""")
def _(spark, sf):
    schema = table(spark, sf, "embeddings").schema
    # a pattern that only the table's own path matches: streams take a folder of parts as it is, but a single file only by a pattern
    e = spark.readStream.schema(schema).parquet(f"{sf}/embeddings.parque[t]")
    fr = e.select(F.col("label").cast("bigint").alias("clip"), F.col("vec_id").cast("double").alias("time"), F.col("embedding").cast("array<double>").alias("sig"))
    folder = jobs.work_folder(spark)
    stream = jobs.stream_boundaries(jobs.with_closings(fr, folder), ["clip"], 0.142, 30.0, delay=1e6)
    jobs.run_to_table(stream, folder, "boundaries")
    jobs.close(spark, folder, 1e9)
    path = jobs.run_to_table(stream, folder, "boundaries")
    rows = spark.read.schema("clip bigint, time double, score double, kind string").parquet(path)
    return rows.where("kind = 'boundary'").select("clip", "time", r6(F.col("score")).alias("score"))


@query("st2_incremental_index", """SELECT o_orderkey AS path, md5(o_orderkey || '|' || (floor(o_totalprice)::INT + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)) AS fingerprint, length(o_orderpriority)::INT AS n_shots FROM orders WHERE o_orderkey % 9 <> 0""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    price = F.floor("o_totalprice").cast("int")
    listing = lambda extra: o.select(F.col("o_orderkey").alias("path"), F.md5(F.concat(F.col("o_orderkey"), F.lit("|"), (price + extra).cast("string"))).alias("fingerprint"), "o_orderpriority")
    folder = jobs.work_folder(spark)
    drops = {1: listing(F.lit(0)).where("path % 10 <> 0"), 2: listing(F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).where("path % 9 <> 0")}
    for number, rows in drops.items():
        closing = rows.agg(F.count(F.lit(1)).alias("closes"))
        rows.unionByName(closing, allowMissingColumns=True).withColumn("listing", F.lit(number).cast("bigint")).write.parquet(f"{folder}/drops/{number}")
    stream = spark.readStream.schema("path bigint, fingerprint string, o_orderpriority string, closes bigint, listing bigint").option("maxFilesPerTrigger", 64).parquet(f"{folder}/drops/*")
    index = jobs.IncrementalIndex(folder, "path", "fingerprint", lambda df: df.select("path", "fingerprint", F.length("o_orderpriority").alias("n_shots")))
    return index.read(spark, "path bigint, fingerprint string, n_shots int", index.run(stream))
