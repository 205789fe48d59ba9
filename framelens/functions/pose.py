"""Head pose, landmark and reference-quality expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Conditioning modes that count as truly three-dimensional.
TRULY_CONDITIONED_MODES = ("3dmm_internal", "flame_internal", "gaussian_3d_internal")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def pose_from_kps(kps: Column) -> tuple[Column, Column]:
    """(yaw, pitch) in degrees from eyes, nose and mouth corners; 0, 0 with fewer than five points."""
    p = [F.get(kps, F.lit(i)) for i in range(5)]
    eyes_x, eyes_y = (p[0]["x"] + p[1]["x"]) * 0.5, (p[0]["y"] + p[1]["y"]) * 0.5
    mouth_x, mouth_y = (p[3]["x"] + p[4]["x"]) * 0.5, (p[3]["y"] + p[4]["y"]) * 0.5
    eye_gap = F.greatest(F.lit(1.0), F.hypot(p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"]))
    face_height = F.greatest(F.lit(1.0), F.hypot(mouth_x - eyes_x, mouth_y - eyes_y))
    yaw = clip((p[2]["x"] - eyes_x) / eye_gap * 55.0, -60.0, 60.0)
    pitch = clip((p[2]["y"] - (eyes_y + 0.52 * face_height)) / face_height * 55.0, -40.0, 40.0)
    usable = F.coalesce(F.size(kps) >= 5, F.lit(False))
    zero = F.lit(0.0)
    return F.when(usable, yaw).otherwise(zero), F.when(usable, pitch).otherwise(zero)


def pose_weight(kps: Column, pose: Column | None = None) -> Column:
    """Weight of a view by its turn; an explicit ``pose`` array [pitch, yaw, …] wins over the points."""
    yaw, pitch = pose_from_kps(kps)
    if pose is not None:
        given = F.coalesce(F.size(pose) >= 2, F.lit(False))
        pitch = F.when(given, F.get(pose, F.lit(0))).otherwise(pitch)
        yaw = F.when(given, F.get(pose, F.lit(1))).otherwise(yaw)
    return turn_weight(yaw, pitch)


def turn_weight(yaw: Column, pitch: Column) -> Column:
    return F.greatest(F.lit(0.20), F.exp(-(F.abs(pitch) + F.abs(yaw)) / 70.0))


def reference_weight(score: Column, area_ratio: Column, turn: Column, quality: Column) -> Column:
    return F.greatest(F.lit(1e-4), score * F.sqrt(area_ratio) * turn * (0.45 + 0.55 * quality))


def image_quality(sharpness_var: Column, mean: Column, clipped_fraction: Column) -> Column:
    sharp = clip(F.log1p(sharpness_var) / F.log(F.lit(1001.0)), 0.0, 1.0)
    exposure = F.exp(-F.pow((mean - 128.0) / 95.0, F.lit(2.0)))
    unclipped = F.lit(1.0) - F.least(F.lit(1.0), clipped_fraction * 4.0)
    return clip(0.55 * sharp + 0.30 * exposure + 0.15 * unclipped, 0.0, 1.0)


def euler_from_matrix(matrix: Column) -> Column:
    """STRUCT<pitch, yaw, roll> in degrees from a rotation given as nested arrays."""
    m = lambda i, j: matrix[i][j].cast("double")
    flat = F.sqrt(m(0, 0) * m(0, 0) + m(1, 0) * m(1, 0))
    locked = flat < 1e-6
    pitch = F.when(locked, F.atan2(-m(1, 2), m(1, 1))).otherwise(F.atan2(m(2, 1), m(2, 2)))
    yaw = F.atan2(-m(2, 0), flat)
    roll = F.when(locked, F.lit(0.0)).otherwise(F.atan2(m(1, 0), m(0, 0)))
    return F.struct(
        F.degrees(pitch).alias("pitch"), F.degrees(yaw).alias("yaw"), F.degrees(roll).alias("roll")
    )


def axis_confidence(angle: Column, start: float, limit: float) -> Column:
    """1 up to ``start`` degrees, 0 from ``limit`` on, linear in between."""
    size = F.abs(angle)
    return (
        F.when(size <= start, F.lit(1.0))
        .when(size >= limit, F.lit(0.0))
        .otherwise(F.lit(1.0) - (size - start) / max(limit - start, 1e-6))
    )


def pose_opacity(
    confidence: Column, pitch: Column, yaw: Column, *, pitch_range=(28.0, 58.0), yaw_range=(50.0, 78.0),
    floor: float = 0.28,
) -> Column:
    certain = (
        clip(confidence, 0.0, 1.0)
        * F.coalesce(axis_confidence(pitch, *pitch_range), F.lit(1.0))
        * F.coalesce(axis_confidence(yaw, *yaw_range), F.lit(1.0))
    )
    return F.when(certain <= 0, F.lit(0.0)).otherwise(clip(F.greatest(F.lit(floor), certain), 0.0, 1.0))


def landmark_confidence(values: Column) -> Column:
    """Mean of the positive presence/visibility values, clipped to [0, 1]; 1 when there is none."""
    positive = F.filter(values, lambda v: v > 0)
    total = F.aggregate(positive.cast("array<double>"), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(
        F.when(F.size(positive) > 0, clip(total / F.size(positive), 0.0, 1.0)), F.lit(1.0)
    )


def landmark_error(actual: Column, expected: Column) -> Column:
    """Mean point distance relative to the expected eye gap; null with fewer than five points."""
    distances = F.zip_with(actual, expected, lambda a, e: F.hypot(a["x"] - e["x"], a["y"] - e["y"]))
    gap = F.hypot(expected[1]["x"] - expected[0]["x"], expected[1]["y"] - expected[0]["y"])
    mean = F.aggregate(distances, F.lit(0.0), lambda acc, d: acc + d) / F.size(distances)
    return F.when((F.size(actual) >= 5) & (F.size(expected) >= 5), mean / F.greatest(F.lit(1.0), gap))


def truly_conditioned(mode: Column) -> Column:
    return mode.isin(*TRULY_CONDITIONED_MODES)


__all__ = [
    "axis_confidence", "clip", "euler_from_matrix", "image_quality", "landmark_confidence", "landmark_error",
    "pose_from_kps", "pose_opacity", "pose_weight", "reference_weight", "truly_conditioned", "turn_weight",
]
