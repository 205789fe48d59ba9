"""Bounding-box geometry. A box is four Columns, so boxes cost nothing until Catalyst inlines them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        """Columns ``<prefix>x1 … <prefix>y2``."""
        return cls(*(F.col(f"{prefix}{name}") for name in ("x1", "y1", "x2", "y2")))

    @classmethod
    def in_struct(cls, value: Column) -> "Box":
        return cls(value["x1"], value["y1"], value["x2"], value["y2"])

    @classmethod
    def lit(cls, x1: float, y1: float, x2: float, y2: float) -> "Box":
        return cls(*(F.lit(float(v)) for v in (x1, y1, x2, y2)))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) * 0.5, (self.y1 + self.y2) * 0.5

    def as_struct(self) -> Column:
        return F.struct(*(value.alias(name) for name, value in zip(self._fields, self)))


def _at_least(column: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), column)


def bbox_area(box: Box) -> Column:
    return _at_least(box.width, _ZERO) * _at_least(box.height, _ZERO)


def bbox_iou(a: Box, b: Box) -> Column:
    shared_w = _at_least(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), _ZERO)
    shared_h = _at_least(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), _ZERO)
    shared = shared_w * shared_h
    union = bbox_area(a) + bbox_area(b) - shared
    return F.when(union <= 0, F.lit(_ZERO)).otherwise(shared / union)


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = a.center, b.center
    return F.hypot(ax - bx, ay - by)


def bbox_diagonal(box: Box) -> Column:
    return _at_least(F.hypot(box.width, box.height), 1.0)


# Spatial gate and blend weights of the track-to-detection score.
ASSOCIATION_GATE = 2.4
ASSOCIATION_SIMILARITY_WEIGHT = 0.55
ASSOCIATION_CONTINUITY_WEIGHT = 0.45
ASSOCIATION_IOU_WEIGHT = 0.72
ASSOCIATION_PROXIMITY_WEIGHT = 0.28


def association_score(previous: Box, current: Box, similarity: Column) -> Column:
    """Score of giving ``current`` to the track at ``previous``; null when it is out of reach."""
    iou = bbox_iou(previous, current)
    reach = center_distance(previous, current) / F.greatest(bbox_diagonal(previous), bbox_diagonal(current))
    proximity = _at_least(F.lit(1.0) - reach / ASSOCIATION_GATE, _ZERO)
    continuity = ASSOCIATION_IOU_WEIGHT * iou + ASSOCIATION_PROXIMITY_WEIGHT * proximity
    score = ASSOCIATION_SIMILARITY_WEIGHT * similarity + ASSOCIATION_CONTINUITY_WEIGHT * continuity
    return F.when((iou > 0) | (reach <= ASSOCIATION_GATE), score)


def target_score(similarity, overlap):
    """For columns and plain numbers."""
    return 0.78 * similarity + 0.22 * overlap


def selection_score(similarity: Column, current: Box, previous: Box | None = None) -> Column:
    overlap = F.lit(_ZERO) if previous is None else F.coalesce(bbox_iou(current, previous), F.lit(_ZERO))
    return target_score(similarity, overlap)


def continuity_score(current: Box, previous: Box, width, height) -> Column:
    diagonal = _at_least(F.hypot(_num(width), _num(height)), 1.0)
    nearness = F.lit(1.0) - F.least(F.lit(1.0), center_distance(current, previous) / diagonal)
    return 0.78 * bbox_iou(current, previous) + 0.22 * nearness


def quality_rank(box: Box, score: Column) -> Column:
    return bbox_area(box) * F.coalesce(score, F.lit(_ZERO))


def best_face_score(box: Box, score: Column, width, height) -> Column:
    """Large, confident and central detections first."""
    w, h = _num(width), _num(height)
    cx, cy = box.center
    penalty = F.hypot((cx - w / 2.0) / _at_least(w, 1.0), (cy - h / 2.0) / _at_least(h, 1.0))
    return quality_rank(box, score) * (F.lit(1.0) - F.least(penalty, F.lit(0.8)))


def bbox_visible(box: Box, width, height) -> Column:
    return (box.x2 > 0) & (box.y2 > 0) & (box.x1 < _num(width)) & (box.y1 < _num(height))


class Affine(NamedTuple):
    """Two rows of a 2x3 matrix."""

    m00: Column
    m01: Column
    m02: Column
    m10: Column
    m11: Column
    m12: Column

    @classmethod
    def of(cls) -> "Affine":
        return cls(*(F.col(name) for name in cls._fields))

    @classmethod
    def in_array(cls, values: Column) -> "Affine":
        return cls(*(values[i] for i in range(6)))

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.m00 * x + self.m01 * y + self.m02, self.m10 * x + self.m11 * y + self.m12


# Accepted frame-to-frame motion.
MIN_MOTION_SCALE, MAX_MOTION_SCALE, MAX_MOTION_SHIFT = 0.70, 1.40, 0.35


def valid_affine(motion: Affine, width, height) -> Column:
    scale_x, scale_y = F.hypot(motion.m00, motion.m10), F.hypot(motion.m01, motion.m11)
    shift = F.hypot(motion.m02, motion.m12)
    return (
        scale_x.between(MIN_MOTION_SCALE, MAX_MOTION_SCALE)
        & scale_y.between(MIN_MOTION_SCALE, MAX_MOTION_SCALE)
        & (shift <= MAX_MOTION_SHIFT * F.greatest(_num(width), _num(height)))
    )


def affine_bbox(box: Box, motion: Affine) -> Box:
    """Axis-parallel box around the four moved corners."""
    corners = [motion.apply(x, y) for x in (box.x1, box.x2) for y in (box.y1, box.y2)]
    xs, ys = F.array(*(c[0] for c in corners)), F.array(*(c[1] for c in corners))
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def affine_points(points: Column, motion: Affine) -> Column:
    """Move an array of {x, y} structs."""

    def move(point: Column) -> Column:
        x, y = motion.apply(point["x"], point["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, move)


def pad_bbox(box: Box, ratio: float, width, height, *, mode: str = "square", min_side: float = 1.0) -> Box:
    """Integer crop bounds around a padded box, clamped to the frame; all null when the crop is empty."""
    if mode == "square":
        margin_x = margin_y = F.greatest(box.width, box.height, F.lit(min_side)) * ratio
    elif mode == "per_axis":
        margin_x, margin_y = _at_least(box.width, min_side) * ratio, _at_least(box.height, min_side) * ratio
    else:
        raise ValueError("mode must be 'square' or 'per_axis'")
    zero = F.lit(0).cast("long")
    x1 = F.greatest(zero, F.floor(box.x1 - margin_x))
    y1 = F.greatest(zero, F.floor(box.y1 - margin_y))
    x2 = F.least(_num(width).cast("long"), F.ceil(box.x2 + margin_x))
    y2 = F.least(_num(height).cast("long"), F.ceil(box.y2 + margin_y))
    filled = (x2 > x1) & (y2 > y1)
    return Box(*(F.when(filled, edge) for edge in (x1, y1, x2, y2)))


def scale_instances(instances: Column, scale_x, scale_y) -> Column:
    """Rescale boxes and points of an ARRAY<STRUCT<x1,y1,x2,y2,kps,…>> to another resolution."""
    sx, sy = _num(scale_x), _num(scale_y)

    def rescale(item: Column) -> Column:
        points = F.transform(
            item["kps"], lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y"))
        )
        return (
            item.withField("x1", item["x1"] * sx)
            .withField("y1", item["y1"] * sy)
            .withField("x2", item["x2"] * sx)
            .withField("y2", item["y2"] * sy)
            .withField("kps", points)
        )

    return F.transform(instances, rescale)


class Ellipse(NamedTuple):
    """Centre, radii, and cosine and sine of the turn."""

    x: Column
    y: Column
    radius_x: Column
    radius_y: Column
    cos: Column
    sin: Column

    def contains(self, px: Column, py: Column) -> Column:
        dx, dy = px - self.x, py - self.y
        dx, dy = dx * self.cos + dy * self.sin, dy * self.cos - dx * self.sin
        return F.pow(dx / self.radius_x, F.lit(2.0)) + F.pow(dy / self.radius_y, F.lit(2.0)) <= 1.0

    def span(self, py: Column) -> tuple[Column, Column]:
        """First and last whole x inside on the line ``py``; null where there is none.

        The line cuts the ellipse at the roots of a quadratic. Rounding may move a root across a whole number, so the
        neighbours of both are tried.
        """
        dy = py - self.y
        ax, ay = F.lit(1.0) / (self.radius_x * self.radius_x), F.lit(1.0) / (self.radius_y * self.radius_y)
        square = self.cos * self.cos * ax + self.sin * self.sin * ay
        half = dy * self.cos * self.sin * (ax - ay)
        rest = dy * dy * (self.sin * self.sin * ax + self.cos * self.cos * ay) - 1.0
        root = F.sqrt(F.greatest(F.lit(0.0), half * half - square * rest))
        low, high = F.ceil(self.x + (-half - root) / square), F.floor(self.x + (-half + root) / square)
        inside = lambda x: F.when(self.contains(x.cast("double"), py), x)
        return F.coalesce(*(inside(low + i) for i in (-1, 0, 1))), F.coalesce(*(inside(high + i) for i in (1, 0, -1)))


def face_ellipse(
    box: Box, *, expand: float = 1.08, variant: str = "plain",
    left_eye: tuple[Column, Column] | None = None, right_eye: tuple[Column, Column] | None = None,
) -> Ellipse:
    """The face ellipse of a box.

    ``plain`` is upright; ``oriented`` is turned by the line through the eyes and never shrinks below 0.75.
    """
    w, h = _at_least(box.width, 2.0), _at_least(box.height, 2.0)
    if variant == "plain":
        axis_x, axis_y, drop, grow = 0.50, 0.56, 0.53, expand
    elif variant == "oriented":
        axis_x, axis_y, drop, grow = 0.51, 0.58, 0.52, max(0.75, expand)
    else:
        raise ValueError("variant must be 'plain' or 'oriented'")
    cos_a, sin_a = F.lit(1.0), F.lit(0.0)
    if variant == "oriented" and left_eye is not None and right_eye is not None:
        ex, ey = right_eye[0] - left_eye[0], right_eye[1] - left_eye[1]
        angle = F.when(F.hypot(ex, ey) > 1e-3, F.atan2(ey, ex)).otherwise(F.lit(0.0))
        cos_a, sin_a = F.cos(angle), F.sin(angle)
    return Ellipse(
        F.bround(box.center[0]), F.bround(box.y1 + drop * h), _at_least(F.bround(axis_x * w * grow), 2.0),
        _at_least(F.bround(axis_y * h * grow), 2.0), cos_a, sin_a,
    )


def ellipse_contains(px: Column, py: Column, box: Box, **shape) -> Column:
    """Whether a point lies in the face ellipse of a box (analytic, hard edge); ``shape`` as for ``face_ellipse``."""
    return face_ellipse(box, **shape).contains(px, py)


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
