"""Shot label, framing and camera expressions.  All return Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise import constants as C
from framewise.operators import kernels as N


def clamp(x: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(low, F.least(high, x))


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def classify_shot_size(height: Column) -> Column:
    label = F.lit("extreme_close_up")
    for name, limit in reversed(C.SIZE_LIMITS):
        label = F.when(height <= limit, name).otherwise(label)
    return label


def focus_ratio(size: Column) -> Column:
    return lookup(C.FOCUS_RATIO, size)


def visible_ratio(size: Column) -> Column:
    return lookup(C.VISIBLE_RATIO, size)


def lens_mm(size: Column) -> Column:
    return lookup(C.LENS_MM, size)


def default_fraction(size: Column) -> Column:
    return lookup(C.DEFAULT_FRACTION, size)


def classify_composition(main_x: Column, xs_sorted: Column) -> Column:
    middle = (F.get(xs_sorted, F.lit(0)) + F.get(xs_sorted, F.lit(1))) / 2
    near_third = F.least(F.abs(main_x - 1.0 / 3.0), F.abs(main_x - 2.0 / 3.0))
    return (F.when((F.size(xs_sorted) >= 2) & (F.abs(middle - 0.5) < 0.08), "symmetry")
            .when(F.abs(main_x - 0.5) < 0.07, "center")
            .when(near_third < 0.09, "thirds").otherwise("leading_space"))


def sensor_height(aspect: Column) -> Column:
    return F.lit(C.SENSOR_WIDTH_MM) / clamp(aspect, 0.25, 4.0)


def tan_half(sensor: Column, lens: Column) -> Column:
    """Tangent of half the field of view."""
    return sensor / (F.greatest(F.lit(1.0), lens) * 2)


def camera_axes(pitch: Column, yaw: Column, roll: Column) -> tuple[tuple, tuple, tuple]:
    """Forward, right and up unit vectors of a camera (degrees, x forward, z up)."""
    sp, cp = F.sin(F.radians(pitch)), F.cos(F.radians(pitch))
    sy, cy = F.sin(F.radians(yaw)), F.cos(F.radians(yaw))
    sr, cr = F.sin(F.radians(roll)), F.cos(F.radians(roll))
    forward = (cp * cy, cp * sy, sp)
    right = (sr * sp * cy - cr * sy, sr * sp * sy + cr * cy, -sr * cp)
    up = (-(cr * sp * cy + sr * sy), cy * sr - cr * sp * sy, cr * cp)
    return forward, right, up


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def project_to_screen(camera, axes, point, lens: Column, aspect: Column) -> tuple[Column, Column]:
    """Pinhole projection to (0..1, 0..1); null behind the camera."""
    delta = tuple(p - c for p, c in zip(point, camera))
    depth, across, above = (dot(delta, axis) for axis in axes)
    ahead = depth > 1e-4
    x = 0.5 + 0.5 * (across / depth) / tan_half(F.lit(C.SENSOR_WIDTH_MM), lens)
    y = 0.5 - 0.5 * (above / depth) / tan_half(sensor_height(aspect), lens)
    return F.when(ahead, x), F.when(ahead, y)


def screen_delta_to_degrees(delta: Column, lens: Column, sensor: Column, steps: Column) -> Column:
    n = F.greatest(F.lit(1), steps)
    return n * F.degrees(F.atan(delta / n * 2 * tan_half(sensor, lens)))


def camera_height(angle: Column, distance: Column, body: Column, focus: Column) -> Column:
    floor = F.greatest(F.lit(0.0), F.greatest(F.lit(30.0), body) * focus - 20.0)
    height = (F.when(angle == "low", -F.least(distance * F.tan(F.radians(F.lit(15.0))), floor))
              .when(angle == "high", distance * F.tan(F.radians(F.lit(25.0))))
              .when(angle == "overhead", distance * F.tan(F.radians(F.lit(60.0)))).otherwise(F.lit(0.0)))
    return clamp(height, -5000.0, 5000.0)


def shot_framing(size: Column, angle: Column, body: Column, fraction: Column, aspect: Column,
                 screen_x: Column) -> dict[str, Column]:
    """Lens, distance, height and roll that give the wanted share of the frame height."""
    tall = F.greatest(F.lit(30.0), body)
    lens = lens_mm(size)
    distance = clamp(tall * visible_ratio(size) * lens / (sensor_height(aspect) * clamp(fraction, 0.05, 1.0)),
                     50.0, 10000.0)
    roll = F.when(angle == "dutch", F.when(screen_x < 0.5, -10.0).otherwise(10.0)).otherwise(F.lit(0.0))
    return {"focal_length": lens, "focus_height": focus_ratio(size), "distance_cm": distance,
            "height_cm": camera_height(angle, distance, tall, focus_ratio(size)), "camera_roll": roll}


def infer_shot_size(focus: Column, lens: Column) -> Column:
    return (F.when(focus >= 0.9, "extreme_close_up").when(focus >= 0.8, "close_up")
            .when(focus >= 0.6, "medium").when(lens <= 32.0, "wide").otherwise("full"))


def infer_camera_angle(distance: Column, side: Column, height: Column, roll: Column) -> Column:
    radius = F.greatest(F.lit(1.0), F.sqrt(distance * distance + side * side))
    up = F.degrees(F.atan2(height, radius))
    return (F.when(F.abs(roll) > 1.0, "dutch").when(up > 45.0, "overhead").when(up > 12.0, "high")
            .when(up < -5.0, "low").otherwise("eye"))


def motion_end_state(motion: Column, distance: Column, side: Column, height: Column, lens: Column, aspect: Column,
                     has: Column, dx: Column, dy: Column, bg: Column, subj: Column, path: Column,
                     steps: Column) -> dict[str, Column]:
    """Camera state at the end of a move: measured size where there is one, else a fixed size."""
    tan_h = tan_half(F.lit(C.SENSOR_WIDTH_MM), lens)
    tan_v = tan_half(sensor_height(aspect), lens)
    dolly = F.when(has & (subj > 0.05), F.greatest(F.lit(20.0), distance / subj)).otherwise(
        distance * F.when(motion == "dolly_in", 0.65).otherwise(1.4))
    across = F.when(has, F.abs(dx) * distance * 2 * tan_h).otherwise(F.lit(0.0))
    lift = F.when(has, F.abs(dy) * distance * 2 * tan_v).otherwise(F.lit(0.0))
    truck = F.when(across > 1.0, across).otherwise(F.greatest(F.lit(100.0), distance * 0.35))
    rise = F.when(lift > 1.0, lift).otherwise(F.greatest(F.lit(100.0), distance * 0.25))
    zoom = F.when(has & (bg > 0.05), bg).otherwise(F.when(motion == "zoom_in", 1.45).otherwise(0.72))
    shake = F.when(has, clamp(path / 0.15, 0.3, 3.0)).otherwise(F.lit(1.0))
    sensor = F.lit(C.SENSOR_WIDTH_MM)
    return {
        "end_distance": F.when(motion.isin("dolly_in", "dolly_out"), dolly).otherwise(distance),
        "end_side": side + F.when(motion == "truck_left", -truck).when(
            motion.isin("truck_right", "tracking"), truck).when(
            motion == "orbit", F.greatest(F.lit(150.0), distance * 0.65)).otherwise(F.lit(0.0)),
        "end_height": height + F.when(motion == "pedestal", rise).otherwise(F.lit(0.0)),
        "end_lens": F.when(motion.isin("zoom_in", "zoom_out"), clamp(lens * zoom, 8.0, 200.0)).otherwise(lens),
        "yaw_delta": F.when(motion == "pan", F.when(has, -screen_delta_to_degrees(dx, lens, sensor, steps))
                            .otherwise(25.0)).when(motion == "handheld", shake * 2.0).otherwise(F.lit(0.0)),
        "pitch_delta": F.when(motion == "tilt", F.when(
            has, screen_delta_to_degrees(dy, lens, sensor_height(aspect), steps)).otherwise(-18.0)).when(
            motion == "handheld", shake * -1.5).otherwise(F.lit(0.0)),
        "roll_delta": F.when(motion == "handheld", shake * 0.8).otherwise(F.lit(0.0)),
        # a hand moves the camera itself, in world axes and centimetres
        **{f"move_{axis}": F.when(motion == "handheld", shake * cm).otherwise(F.lit(0.0)) for axis, cm in (("x", 8.0), ("y", 12.0), ("z", 6.0))},
    }


def position_size_score(error: Column, ratio: Column) -> Column:
    """0..100: half for the position on screen, half for the size."""
    position = F.greatest(F.lit(0.0), 1 - error / 0.15)
    size = F.when(ratio.isNull() | (ratio == 0), 0.5).otherwise(
        F.greatest(F.lit(0.0), 1 - F.abs(F.ln(ratio)) / F.ln(F.lit(1.5))))
    return 100.0 * (0.5 * position + 0.5 * size)


def composition_risk(head_x: Column, head_y: Column, feet_y: Column, focus: Column, side: Column,
                     distance: Column) -> tuple[Column, Column, Column]:
    """Risk points, grade and the reasons behind them."""
    hidden = head_y.isNull() | feet_y.isNull()
    cover = feet_y - head_y
    rules = [
        (hidden, 60, "behind camera"),
        (~hidden & (head_y < 0) & (focus < 0.8), 45, "head cut"),
        (~hidden & (head_y >= 0) & (head_y < 0.03), 15, "low headroom"),
        (~hidden & (cover < 0.08), 25, "too small"),
        (~hidden & ((head_x < -0.05) | (head_x > 1.05)), 30, "off screen"),
        (F.abs(side) > distance * 0.8, 15, "side offset"),
    ]
    points = F.lit(0)
    for test, value, _ in rules:
        points = points + F.when(test, value).otherwise(0)
    points = F.least(F.lit(100), points)
    grade = F.when(points >= 60, "HIGH").when(points >= 30, "CHECK").otherwise("LOW")
    reasons = F.array_compact(F.array(*[F.when(test, text) for test, _, text in rules]))
    return points, grade, reasons


def correction_step(distance: Column, lens: Column, screen_x: Column, screen_y: Column, error_x: Column,
                    error_y: Column, ratio: Column, size: Column, step: Column, over_shoulder: Column):
    """One camera correction towards the measured reference."""
    gain = F.when(size.isin("close_up", "extreme_close_up"), 0.5).otherwise(0.8) * step
    factor = F.when(ratio > 0.05, clamp(F.pow(ratio, gain), 0.75, 1.33)).otherwise(F.lit(1.0))
    return {
        "new_distance": F.when(over_shoulder | (ratio <= 0.05), distance).otherwise(
            clamp(distance * factor, 30.0, 10000.0)),
        "new_lens": F.when(over_shoulder & (ratio > 0.05), clamp(lens / factor, 8.0, 200.0)).otherwise(lens),
        "new_x": clamp(screen_x - error_x * gain, 0.02, 0.98),
        "new_y": clamp(screen_y - error_y * gain, 0.02, 0.98),
    }


def motion_shift(shots: DataFrame, depth: Column, lens: Column, aspect: Column, end_lens: Column, move, turn) -> DataFrame:
    """Screen shift of four still points at ``depth`` seen by a camera that moved and turned.

    move: camera offset in the start camera's axes; turn: (pitch, yaw, roll) in
    degrees.  Adds dx, dy, scale and ``valid``, the number of points seen by both.
    """
    lens_of = lambda mm: (tan_half(F.lit(C.SENSOR_WIDTH_MM), mm), tan_half(sensor_height(aspect), mm))
    inputs = [depth, *lens_of(lens), *lens_of(end_lens), *move, *turn]
    shift = N.still_points()(*[c.cast("double") for c in inputs])
    return shots.withColumn("__s", shift).select(*shots.columns, "__s.dx", "__s.dy", "__s.scale", "__s.valid")
