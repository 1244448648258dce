"""Bindings of the given tables to operator inputs, with the same views in SQL.

Keys are the natural ones: a reel is a user, a clip and a pair of clips are labels, a plan is an order.
Any of them may own a large share of the rows; the operators split it inside, and rows are numbered
here with the blocked ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise import scale
from framewise.plans.registry import table

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
              "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

SIZE_OF_EVENT = {"signup": "wide", "view": "full", "click": "medium", "purchase": "close_up",
                 "error": "extreme_close_up"}
MOTION_OF_REST = ["dolly_in", "dolly_out", "zoom_in", "zoom_out", "handheld", "orbit", "tracking", "tilt",
                  "pan", "static"]


def literal_map(values: dict):
    """Constant lookup map; the value set is fixed, so no join is needed."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (reel, i, t, value, k, event_type), i counts from 1 in the order of ids."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias("reel"), "event_id",
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts) / 1e6").alias("t"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    numbered = scale.ordinal(ev, ["reel"], ["event_id"], "i", block=F.floor(F.col("event_id") / scale.SPAN))
    return numbered.withColumn("i", F.col("i") + 1)


EV = f"""ev AS (SELECT reel, event_id, row_number() OVER (PARTITION BY reel ORDER BY event_id) AS i, t, value, k, event_type
FROM (SELECT user_id::BIGINT AS reel, event_id,
 date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value,
 CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, event_type FROM events))"""


def event_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> shots of one reel: contiguous intervals with labels; the last one lasts ten seconds."""
    ev = scale.following(event_series(spark, sf_dir), ["reel"], "i", {"t1": "t"})
    angle = (F.when(F.col("value") < 10, "low").when(F.col("value") < 35, "eye")
             .when(F.col("value") < 80, "high").otherwise("overhead"))
    motions = F.array(*[F.lit(m) for m in MOTION_OF_REST])
    return ev.select(
        "reel", (F.col("i") - 1).alias("shot_idx"), F.concat(F.lit("Shot_"), F.col("i")).alias("name"),
        F.col("t").alias("start"), F.coalesce("t1", F.col("t") + 10.0).alias("end"),
        literal_map(SIZE_OF_EVENT)[F.col("event_type")].alias("size"), angle.alias("angle"),
        F.get(motions, F.col("k") % 10).alias("motion"), (F.lit(1) + F.col("k") % 3).alias("people"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"))


ES = EV + f""", es AS (SELECT reel, i - 1 AS shot_idx, 'Shot_' || i AS name, t AS "start",
 coalesce(lead(t) OVER (PARTITION BY reel ORDER BY i), t + 10.0) AS "end",
 CASE event_type WHEN 'signup' THEN 'wide' WHEN 'view' THEN 'full' WHEN 'click' THEN 'medium'
  WHEN 'purchase' THEN 'close_up' ELSE 'extreme_close_up' END AS size,
 CASE WHEN value < 10 THEN 'low' WHEN value < 35 THEN 'eye' WHEN value < 80 THEN 'high' ELSE 'overhead' END AS angle,
 ({MOTION_OF_REST})[k % 10 + 1] AS motion, 1 + k % 3 AS people, least(1.0, value / 100.0) AS confidence FROM ev)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (clip, label, frame, vec_id, sig), frame counts from 0; a clip is a label."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("clip"), F.col("label").cast("bigint").alias("label"), "vec_id",
        F.col("embedding").cast("array<double>").alias("sig"))
    return scale.ordinal(e, ["clip"], ["vec_id"], "frame", block=F.floor(F.col("vec_id") / scale.SPAN))


FR = """fr AS (SELECT label::BIGINT AS clip, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id,
 CAST(embedding AS DOUBLE[]) AS sig FROM embeddings)"""


def order_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> (plan, shot_idx, all line columns); a plan is an order."""
    li = table(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return scale.ordinal(li, ["l_orderkey"], LINE_ORDER, "shot_idx", block=month).withColumn("plan", F.col("l_orderkey"))


LS = f"""ls AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS shot_idx, * FROM lineitem)"""


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> one detection per frame: box corners and 17 keypoints in a 1280 x 720 frame."""
    fr = frames(spark, sf_dir)
    kp = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.struct(
        ((F.get("sig", j * 3) * 2 + 0.5) * 1280).alias("x"),
        ((F.get("sig", j * 3 + 1) * 2 + 0.5) * 720).alias("y"),
        F.least(F.lit(1.0), F.abs(F.get("sig", j * 3 + 2)) * 6).alias("score")))
    return fr.select("clip", "label", "frame", "vec_id", kp.alias("kp"),
                     F.abs(F.get("sig", F.lit(51))).alias("b0"), F.abs(F.get("sig", F.lit(52))).alias("b1"),
                     (F.abs(F.get("sig", F.lit(53))) + 0.05).alias("bw"),
                     (F.abs(F.get("sig", F.lit(54))) * 2 + 0.1).alias("bh"))


KP = FR + """, kp AS (SELECT clip, label, frame, vec_id,
 list_transform(range(0, 17), lambda j: {'x': (sig[j*3+1]*2+0.5)*1280, 'y': (sig[j*3+2]*2+0.5)*720,
  'score': least(1.0, abs(sig[j*3+3])*6)}) AS kp,
 abs(sig[52]) AS b0, abs(sig[53]) AS b1, abs(sig[54])+0.05 AS bw, abs(sig[55])*2+0.1 AS bh FROM fr)"""


ROLES = ["Pelvis", "Spine", "Neck", "Head", "LeftUpperArm", "LeftLowerArm", "LeftHand", "RightUpperArm", "RightLowerArm",
         "RightHand", "LeftThigh", "LeftCalf", "LeftFoot", "RightThigh", "RightCalf", "RightFoot", "LeftIndex1",
         "LeftIndex2", "RightThumb1", "RightThumb2", "LeftClavicle"]


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (pair, side, sample, role, x, y, z): the frames of a label against those of the next label.

    Two joints are left out on purpose to exercise the rules for missing roles.
    """
    fr = frames(spark, sf_dir)
    joints = F.array(*[F.struct(F.lit(r).alias("role"), *[F.get("sig", F.lit(3 * j + a)).alias(n) for a, n in enumerate("xyz")])
                       for j, r in enumerate(ROLES)])
    both = F.array(F.struct(F.col("clip").alias("pair"), F.lit("s").alias("side")),
                   F.struct(((F.col("label") + 9) % 10).alias("pair"), F.lit("t").alias("side")))
    out = fr.select("label", F.col("frame").alias("sample"), F.explode(both).alias("p"), joints.alias("j")).select(
        "label", "p.pair", "p.side", "sample", F.inline("j"))
    gone = (((F.col("side") == "s") & (F.col("label") == 3) & (F.col("role") == "Neck"))
            | ((F.col("side") == "t") & (F.col("label") == 5) & (F.col("role") == "LeftCalf")))
    return out.where(~gone).drop("label")


PO = FR + f""", po AS (SELECT pair, side, sample, role, x, y, z FROM (SELECT CASE WHEN sd = 0 THEN clip ELSE (label + 9) % 10 END AS pair, CASE WHEN sd = 0 THEN 's' ELSE 't' END AS side,
 frame AS sample, label, ({ROLES})[j + 1] AS role, sig[3*j+1] AS x, sig[3*j+2] AS y, sig[3*j+3] AS z FROM fr, range(0, 21) a(j), range(0, 2) b(sd))
 WHERE NOT (side = 's' AND label = 3 AND role = 'Neck') AND NOT (side = 't' AND label = 5 AND role = 'LeftCalf'))"""


def twists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (pair, side, sample, role, q): two twist joints per clip, unit quaternions."""
    fr = frames(spark, sf_dir)

    def unit(at: int):
        part = F.slice("sig", at, 4)
        return F.transform(part, lambda x: x / F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, y: a + y * y)))

    rows = F.array(F.struct(F.lit("LeftLowerArm").alias("role"), unit(57).alias("q")),
                   F.struct(F.lit("RightCalf").alias("role"), unit(61).alias("q")))
    both = F.array(F.struct(F.col("clip").alias("pair"), F.lit("s").alias("side")),
                   F.struct(((F.col("label") + 9) % 10).alias("pair"), F.lit("t").alias("side")))
    return fr.select(F.col("frame").alias("sample"), F.explode(both).alias("p"), rows.alias("r")).select(
        "p.pair", "p.side", "sample", F.inline("r"))


TW = FR + f""", tw AS (SELECT CASE WHEN sd = 0 THEN clip ELSE (label + 9) % 10 END AS pair, CASE WHEN sd = 0 THEN 's' ELSE 't' END AS side, frame AS sample,
 (['LeftLowerArm', 'RightCalf'])[k + 1] AS role, list_transform(sig[57+4*k:60+4*k], lambda x: x / sqrt(list_sum(list_transform(sig[57+4*k:60+4*k], lambda y: y*y)))) AS q
 FROM fr, range(0, 2) a(k), range(0, 2) b(sd))"""
