"""Array and vector expressions: signatures, histograms, angles, quaternions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signature_distance(a: Column, b: Column) -> Column:
    """Mean cell distance of two grids of {r,g,b}: 0.7 colour + 0.3 luminance; 1 when not comparable."""
    def luminance(c):
        return c["r"] * 0.3 + c["g"] * 0.59 + c["b"] * 0.11

    cells = F.zip_with(a, b, lambda p, q: 0.7 * (
        F.abs(p["r"] - q["r"]) + F.abs(p["g"] - q["g"]) + F.abs(p["b"] - q["b"])) / 3
        + 0.3 * F.abs(luminance(p) - luminance(q)))
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(comparable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total(cells) / F.size(a)))).otherwise(
        F.lit(1.0))


def mean_abs_distance(a: Column, b: Column) -> Column:
    """Signature distance of single-channel grids."""
    return F.least(F.lit(1.0), total(F.zip_with(a, b, lambda p, q: F.abs(p - q))) / F.size(a))


def bhattacharyya(a: Column, b: Column) -> Column:
    overlap = total(F.zip_with(a, b, lambda p, q: F.sqrt(p * q)))
    mass = total(a) * total(b)
    scale = F.when(mass > 1e-15, 1 / F.sqrt(mass)).otherwise(F.lit(1.0))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - scale * overlap))


def histogram_distance(a: Column, b: Column, colour_bins: int = 72) -> Column:
    """Appearance distance: colour part weighs 0.6, brightness part 0.4."""
    rest = F.size(a) - colour_bins
    return (0.6 * bhattacharyya(F.slice(a, 1, colour_bins), F.slice(b, 1, colour_bins))
            + 0.4 * bhattacharyya(F.slice(a, F.lit(colour_bins + 1), rest),
                                  F.slice(b, F.lit(colour_bins + 1), rest)))


def l1_normalised(values: Column) -> Column:
    return F.transform(values, lambda x: x / F.greatest(total(values), F.lit(1.0)))


def norm3(v) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def vector_angle_deg(a, b) -> Column:
    """Angle between two vectors in degrees; null when one has no length."""
    na, nb = norm3(a), norm3(b)
    cosine = (a[0] * b[0] + a[1] * b[1] + a[2] * b[2]) / (na * nb)
    return F.when((na > 1e-6) & (nb > 1e-6),
                  F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def quaternion_angle_deg(a, b) -> Column:
    d = F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3])
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), d)))


def quaternion_product(a, b) -> tuple:
    """Hamilton product of (x, y, z, w) quaternions."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by,
            aw * by - ax * bz + ay * bw + az * bx,
            aw * bz + ax * by - ay * bx + az * bw,
            aw * bw - ax * bx - ay * by - az * bz)


def conjugate(q) -> tuple:
    return (-q[0], -q[1], -q[2], q[3])


def rotate(q, v) -> tuple:
    """Rotate a vector by a unit quaternion."""
    x, y, z, w = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return (v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx)


def unit4(q) -> tuple:
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(c / n for c in q)


def pose_product(up, own) -> tuple:
    """A transform (x, y, z, qx, qy, qz, qw) below another one: moved and turned by it."""
    moved = rotate(up[3:], own[:3])
    return (*(a + b for a, b in zip(up[:3], moved, strict=True)), *quaternion_product(up[3:], own[3:]))
