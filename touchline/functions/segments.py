"""Boxes, line segments and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Segment = tuple[Column, Column, Column, Column]

#: Parts of a detector's class names and what they stand for; the first that a name holds counts.
CLASS_PARTS = (("ball", "ball"), ("sports ball", "ball"), ("goalkeeper", "goalkeeper"), ("referee", "referee"), ("player", "player"), ("person", "player"))


def foot(box: Segment) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, box[3]


def centre(box: Segment) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def area(box: Segment) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def length(s: Segment) -> Column:
    return F.hypot(s[2] - s[0], s[3] - s[1])


def angle(s: Segment) -> Column:
    """Degrees from 0 to below 180."""
    turned = F.pmod(F.degrees(F.atan2(s[3] - s[1], s[2] - s[0])), F.lit(180.0))
    return F.when(turned >= 180.0, 0.0).otherwise(turned)


def angle_between(a: Column, b: Column) -> Column:
    """The smaller difference of two undirected angles in degrees."""
    turned = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(turned, 180.0 - turned)


def x_at(s: Segment, y: Column) -> Column:
    """Where the segment's line is at a height; its middle for a level one."""
    return F.when(F.abs(s[3] - s[1]) < 1e-6, (s[0] + s[2]) / 2).otherwise(s[0] + (y - s[1]) / (s[3] - s[1]) * (s[2] - s[0]))


def y_at(s: Segment, x: Column) -> Column:
    return F.when(F.abs(s[2] - s[0]) < 1e-6, (s[1] + s[3]) / 2).otherwise(s[1] + (x - s[0]) / (s[2] - s[0]) * (s[3] - s[1]))


def distance_to(s: Segment, x: Column, y: Column) -> Column:
    """From a point to the segment's line, or to its start where it has no length."""
    n = length(s)
    return F.when(n < 1e-12, F.hypot(x - s[0], y - s[1])).otherwise(F.abs((s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])) / n)


def other_team(team: Column) -> Column:
    """Home for away and away for home; others stay."""
    return F.when(team == "home", "away").when(team == "away", "home").otherwise(team)


def class_of(name: Column) -> Column:
    """The class that a detector's name holds, in any case; null for none."""
    low, found = F.lower(name), F.lit(None).cast("string")
    for part, kind in reversed(CLASS_PARTS):
        found = F.when(low.contains(part), kind).otherwise(found)
    return found


def player_label(entity: Column, jersey: Column, team: Column) -> Column:
    """'#9 (Home)', or 'player 37 (Home)' where the number is not known."""
    return F.concat(F.coalesce(F.concat(F.lit("#"), jersey.cast("string")), F.concat(F.lit("player "), entity.cast("string"))), F.lit(" ("), F.initcap(team), F.lit(")"))
