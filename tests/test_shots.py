import math

import numpy as np
from pyspark.sql import functions as F

from framewise.functions import shot as S
from framewise.operators import metrics as M


def values(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_size_limits_belong_to_the_smaller_label(spark):
    row = values(spark, **{f"v{i}": S.classify_shot_size(F.lit(h)) for i, h in enumerate([0.45, 0.451, 1.3, 2.8, 5.5, 5.51])})
    assert list(row) == ["wide", "full", "full", "medium", "close_up", "extreme_close_up"]


def test_pan_is_converted_step_by_step(spark):
    """Six equal steps of three degrees are eighteen degrees again."""
    step = math.tan(math.radians(3.0)) / (2 * 18.0 / 35.0)
    row = values(spark, d=S.screen_delta_to_degrees(F.lit(6 * step), F.lit(35.0), F.lit(36.0), F.lit(6)))
    assert abs(row["d"] - 18.0) < 1e-9


def test_projection_of_the_aim_point_is_the_centre(spark):
    axes = S.camera_axes(F.lit(10.0), F.lit(40.0), F.lit(5.0))
    forward = tuple(100 * c for c in axes[0])
    x, y = S.project_to_screen((F.lit(0.0),) * 3, axes, forward, F.lit(50.0), F.lit(1.5))
    bx, _ = S.project_to_screen((F.lit(0.0),) * 3, axes, tuple(-c for c in forward), F.lit(50.0), F.lit(1.5))
    row = values(spark, x=x, y=y, b=bx)
    assert abs(row["x"] - 0.5) < 1e-9 and abs(row["y"] - 0.5) < 1e-9 and row["b"] is None


def test_shift_of_a_pan_keeps_the_scale(spark):
    df = spark.range(1)
    r = S.motion_shift(df, F.lit(500.0), F.lit(50.0), F.lit(1.78), F.lit(50.0), (F.lit(0.0),) * 3, (F.lit(0.0), F.lit(5.0), F.lit(0.0))).first()
    assert r["valid"] == 4 and r["dx"] < -0.1 and abs(r["dy"]) < 1e-3 and abs(r["scale"] - 1.0) < 0.06
    z = S.motion_shift(df, F.lit(500.0), F.lit(50.0), F.lit(1.78), F.lit(75.0), (F.lit(0.0),) * 3, (F.lit(0.0),) * 3).first()
    assert abs(z["scale"] - 1.5) < 1e-9


def test_identical_poses_have_no_error(spark):
    rng = np.random.default_rng(2)
    rows = [(1, side, s, r, *[float(v) for v in p]) for s in range(5) for r in ("Pelvis", "Spine", "Neck", "Head") for p in [rng.random(3)] for side in "st"]
    df = spark.createDataFrame(rows, "pair int, side string, sample int, role string, x double, y double, z double")
    segments = [("Pelvis", "Spine"), ("Neck", "Head"), ("Spine", "Tail")]
    angles = M.segment_angles(df, segments)
    assert angles.count() == 10 and angles.agg(F.max("deg")).first()[0] < 1e-5
    assert M.pair_error(angles, segments).first()["segments_compared"] == 2


def test_motion_shift_works_on_batches_and_keeps_points_behind_apart(spark):
    rows = [(500.0, 0.0, 0.0), (500.0, 600.0, 0.0), (None, 0.0, 0.0), (500.0, 0.0, 88.0), (500.0, 100.0, 10.0)]
    df = spark.createDataFrame(rows, "depth double, forward double, yaw double")
    out = S.motion_shift(df, F.col("depth"), F.lit(50.0), F.lit(1.78), F.lit(50.0), (F.col("forward"), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.col("yaw"), F.lit(0.0)))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    a, behind, none, part, both = out.collect()
    assert (a.dx, a.dy, a.scale, a.valid) == (0.0, 0.0, 1.0, 4)
    assert (behind.dx, behind.scale, behind.valid) == (None, 1.0, 0) and (none.dx, none.dy, none.scale, none.valid) == (None, None, 1.0, 0)
    assert part.valid in (3, 4) and part.dx is not None
    assert both.valid == 4 and both.scale > 1.2
