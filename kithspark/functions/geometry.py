"""Column functions over boxes (x1, y1, x2, y2) and landmarks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kithspark.schemas import CROP_MARGIN, IOU, MIN_EYE_PIXELS, PROXIMITY, SPREAD, TEMPLATE_BOTTOM, TEMPLATE_EDGE, TEMPLATE_GAP, TEMPLATE_TOP

SIDES = ("x1", "y1", "x2", "y2")


def box(*sides: Column) -> Column:
    return F.struct(*[s.cast("double").alias(n) for s, n in zip(sides, SIDES)])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def diagonal(b: Column) -> Column:
    return F.hypot(width(b), height(b))


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 for boxes apart or without area."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    joint = area(a) + area(b) - w * h
    return F.when((w * h > 0) & (joint > 0), w * h / joint).otherwise(0.0)


def same_face(a: Column, b: Column, overlap: float = IOU, proximity: float | None = PROXIMITY) -> Column:
    """Whether two boxes of an image overlap enough or, unless ``proximity`` is None, have centres close enough."""
    near = iou(a, b) >= overlap
    if proximity is None:
        return near
    (ax, ay), (bx, by) = centre(a), centre(b)
    small = F.least(diagonal(a), diagonal(b))
    return near | ((small > 0) & (F.hypot(ax - bx, ay - by) <= proximity * small))


def clipped(b: Column, w: Column, h: Column) -> Column:
    """The part of a box within the frame, null if there is none."""
    c = box(F.greatest(b["x1"], F.lit(0)), F.greatest(b["y1"], F.lit(0)), F.least(b["x2"], w), F.least(b["y2"], h))
    return F.when((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), c)


def crop_box(b: Column, w: Column, h: Column) -> Column:
    """A box with a margin, within the frame; the whole image for a degenerate one."""
    dx, dy = F.greatest(width(b), F.lit(1.0)) * CROP_MARGIN, F.greatest(height(b), F.lit(1.0)) * CROP_MARGIN
    left, top = F.greatest(F.floor(b["x1"] - dx), F.lit(0)), F.greatest(F.floor(b["y1"] - dy), F.lit(0))
    right, bottom = F.least(F.ceil(b["x2"] + dx), w - 1), F.least(F.ceil(b["y2"] + dy), h - 1)
    whole = box(F.lit(0), F.lit(0), F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1)))
    return F.when((right <= left) | (bottom <= top), whole).otherwise(box(left, top, right, bottom))


def valid_landmarks(points: Column) -> Column:
    """Five finite points (arrays of two numbers): the eyes, the nose, the mouth's corners."""
    good = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce((F.size(points) == 5) & F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, good)), F.lit(False))


def eye_span(points: Column) -> Column:
    a, b = points[0], points[1]
    return F.hypot(a[0] - b[0], a[1] - b[1])


def _eye_middle(points: Column) -> tuple[Column, Column]:
    return (points[0][0] + points[1][0]) / 2, (points[0][1] + points[1][1]) / 2


def expanded_landmarks(points: Column, spread: float = SPREAD) -> Column:
    """The eyes where they are, the other points moved towards the middle between the eyes."""
    if spread <= 0:
        raise ValueError("spread must be positive")
    mx, my = _eye_middle(points)
    moved = lambda p: F.array(mx + (p[0] - mx) * spread, my + (p[1] - my) * spread)
    return F.when(valid_landmarks(points), F.transform(points, lambda p, i: F.when(i < 2, F.transform(p, lambda x: x.cast("double"))).otherwise(moved(p))))


def periocular_box(points: Column, spread: float = SPREAD) -> Column:
    """Bounds of the eye region in whole pixels; null for invalid points or eyes that coincide."""
    per = eye_span(points) * (spread if spread > 0 else 1.0) / TEMPLATE_GAP
    mx, my = _eye_middle(points)
    half = TEMPLATE_EDGE / 2 * per
    b = box(F.floor(mx - half), F.floor(my - TEMPLATE_TOP * per), F.ceil(mx + half), F.ceil(my + TEMPLATE_BOTTOM * per))
    return F.when(valid_landmarks(points) & (eye_span(points) > 0), b)


def large_enough(b: Column, pixels: int = MIN_EYE_PIXELS) -> Column:
    return F.least(width(b), height(b)) >= pixels


def grid_columns(count: Column) -> Column:
    """Columns of a compact grid of ``count`` tiles, five at most."""
    return F.least(F.lit(5), F.ceil(F.sqrt(F.greatest(count, F.lit(1)).cast("double")))).cast("int")
