"""Lines and conics of the plane as column expressions.

A line is (a, b, c): a x + b y + c = 0. A conic is (a, b, c, d, e, f):
a x^2 + b x y + c y^2 + d x + e y + f = 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Conic = tuple[Column, Column, Column, Column, Column, Column]
Line = tuple[Column, Column, Column]


def circle(x: Column, y: Column, radius: Column) -> Conic:
    return F.lit(1.0), F.lit(0.0), F.lit(1.0), -2 * x, -2 * y, x * x + y * y - radius * radius


def polar(conic: Conic, x: Column, y: Column) -> Line:
    """The line through the points at which tangents from (x, y) touch; the tangent itself for a point of the conic."""
    a, b, c, d, e, f = conic
    return a * x + b / 2 * y + d / 2, b / 2 * x + c * y + e / 2, d / 2 * x + e / 2 * y + f


def pole(conic: Conic, line: Line) -> tuple[Column, Column]:
    """The point whose polar the line is; null if there is none at a finite place."""
    a, b, c, d, e, f = conic
    p, q, r = line
    b2, d2, e2 = b / 2, d / 2, e / 2
    x = (c * f - e2 * e2) * p + (d2 * e2 - b2 * f) * q + (b2 * e2 - c * d2) * r
    y = (d2 * e2 - b2 * f) * p + (a * f - d2 * d2) * q + (b2 * d2 - a * e2) * r
    w = (b2 * e2 - c * d2) * p + (b2 * d2 - a * e2) * q + (a * c - b2 * b2) * r
    known = F.abs(w) > 1e-12
    return F.when(known, x / w), F.when(known, y / w)


def meets(conic: Conic, line: Line) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Both points at which the line meets the conic, equal for a tangent, null if it does not meet it twice."""
    a, b, c, d, e, f = conic
    p, q, r = line
    n = F.nullif(p * p + q * q, F.lit(0.0))
    x0, y0, dx, dy = -p * r / n, -q * r / n, -q, p
    two = a * dx * dx + b * dx * dy + c * dy * dy
    one = 2 * a * x0 * dx + b * (x0 * dy + y0 * dx) + 2 * c * y0 * dy + d * dx + e * dy
    none = a * x0 * x0 + b * x0 * y0 + c * y0 * y0 + d * x0 + e * y0 + f
    inside = one * one - 4 * two * none
    real = (inside >= 0) & (F.abs(two) > 1e-12)
    root = F.sqrt(F.greatest(inside, F.lit(0.0)))
    places = [F.when(real, (-one + s * root) / (2 * two)) for s in (-1, 1)]
    return tuple((x0 + t * dx, y0 + t * dy) for t in places)


def crossing(first: Line, second: Line) -> tuple[Column, Column]:
    """Where two lines cross; null for parallel ones."""
    w = first[0] * second[1] - first[1] * second[0]
    known = F.abs(w) > 1e-9
    return F.when(known, (first[1] * second[2] - first[2] * second[1]) / w), F.when(known, (first[2] * second[0] - first[0] * second[2]) / w)
