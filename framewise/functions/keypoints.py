"""Keypoint expressions on ``array<struct<x,y,score>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise import constants as C


def usable_keypoints(kp: Column, threshold: float, width: float, height: float) -> Column:
    """Indexes of the keypoints that are sure and away from the frame edge."""
    def keep(i: int) -> Column:
        p = F.get(kp, F.lit(i))
        least = max(threshold, 0.5) if i in C.LOWER_KEYPOINTS else threshold
        bottom = height - height * (0.06 if i in C.HIP_AND_LOWER else 0.04)
        return ((p["score"] >= least) & (p["x"] >= width * 0.03) & (p["x"] <= width - width * 0.03)
                & (p["y"] >= height * 0.04) & (p["y"] <= bottom))

    return F.array_compact(F.array(*[F.when(keep(i), F.lit(i)) for i in C.KEYPOINT_RATIO]))


def axis_tilt_degrees(bx: Column, by: Column) -> Column:
    return F.degrees(F.atan2(F.abs(bx), -by))


def tilt_confirmed(kp: Column, visible: Column, bx: Column, by: Column) -> Column:
    """A strong tilt counts only when the first long enough shoulder or hip line agrees with it."""
    tilt = axis_tilt_degrees(bx, by)
    upright = F.least(tilt, 180.0 - tilt)

    def line(left: int, right: int) -> tuple[Column, Column]:
        dx = F.get(kp, F.lit(left))["x"] - F.get(kp, F.lit(right))["x"]
        dy = F.get(kp, F.lit(left))["y"] - F.get(kp, F.lit(right))["y"]
        there = (F.array_contains(visible, left) & F.array_contains(visible, right)
                 & (F.sqrt(dx * dx + dy * dy) >= 6.0))
        return there, F.abs(upright - F.degrees(F.atan2(F.abs(dy), F.abs(dx)))) <= 25.0

    shoulders, shoulders_agree = line(5, 6)
    hips, hips_agree = line(11, 12)
    return ((tilt >= 35.0) & (tilt <= 135.0)
            & F.when(shoulders, shoulders_agree).when(hips, hips_agree).otherwise(F.lit(False)))
