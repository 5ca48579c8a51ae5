"""Expressions of pitch geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Pitch

_PITCH = Pitch()


def distance(ax, ay, bx, by) -> Column:
    """Metres between two points."""
    ax, ay, bx, by = (F.col(c) if isinstance(c, str) else c for c in (ax, ay, bx, by))
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def attacking_x(x: Column, sign: Column, pitch: Pitch = _PITCH) -> Column:
    """x along the direction of attack."""
    return F.when(sign > 0, x).otherwise(pitch.length - x)


def attacking_y(y: Column, sign: Column, pitch: Pitch = _PITCH) -> Column:
    return F.when(sign > 0, y).otherwise(pitch.width - y)


def contains(x: Column, y: Column, margin: float = 2.0, pitch: Pitch = _PITCH) -> Column:
    """Whether a point lies on the pitch or within the margin of it."""
    return x.between(-margin, pitch.length + margin) & y.between(-margin, pitch.width + margin)


def third(x: Column, pitch: Pitch = _PITCH) -> Column:
    """0, 1 or 2; a point on a boundary belongs to the further third."""
    return F.when(x < pitch.length / 3, 0).when(x < 2 * pitch.length / 3, 1).otherwise(2)


def in_penalty_area(x: Column, y: Column, left: bool, pitch: Pitch = _PITCH) -> Column:
    deep = x <= pitch.box_depth if left else x >= pitch.length - pitch.box_depth
    return deep & (F.abs(y - pitch.width / 2) <= pitch.box_half_width)


def cell(value: Column, extent: float, cells: int) -> Column:
    """Index of the grid cell; values outside fall into the edge cells."""
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), (value / extent * cells).cast("int")))


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography of nine coefficients, null where it goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) >= 1e-12
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2), 0 if the union is empty."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = (F.col(c) for c in (*a, *b))
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def grade(value: Column, high: float, medium: float, higher_is_better: bool = True) -> Column:
    """'high', 'medium' or 'low'; a missing value is low."""
    passes = (lambda t: value >= t) if higher_is_better else (lambda t: value <= t)
    return F.when(value.isNull() | F.isnan(value), "low").when(passes(high), "high").when(passes(medium), "medium").otherwise("low")
