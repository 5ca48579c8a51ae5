"""What a camera would see of the derived matches: boxes, candidates of the ball and estimates of the homography, from the same tables.

The camera stands still; ``TO_PIXEL`` is its homography from metres to pixels.
What goes wrong does so by arithmetic on frame and id, so every run is alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pitch import project
from . import lens

TO_PIXEL = np.array([[12.0, 0.0, 40.0], [0.0, 9.0, 30.0], [0.0, 0.004, 1.0]])
TO_PITCH = np.linalg.inv(TO_PIXEL) / np.linalg.inv(TO_PIXEL)[2, 2]

SCHEMA = "match_id, frame, x1, y1, x2, y2, conf, class"


def _boxes(seen: DataFrame) -> DataFrame:
    """Boxes that stand on the players' feet, larger the nearer they are."""
    u, v = project([F.lit(float(h)) for h in TO_PIXEL.ravel()], F.col("x"), F.col("y"))
    height = 30 + F.col("v") / 12
    rows = seen.withColumns({"u": u, "v": v}).withColumn("height", height)
    half = F.col("height") * 0.2
    return rows.select("match_id", "frame", "entity_id", "class", "conf", (F.col("u") - half).alias("x1"), (F.col("v") - F.col("height")).alias("y1"), (F.col("u") + half).alias("x2"), F.col("v").alias("y2"))


def true_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, track_id, x1, y1, x2, y2, class) of every player in every frame."""
    people = lens.tracking(spark, sf_dir, gaps=False).where("entity_id <> -1")
    return _boxes(people).select("match_id", "frame", F.col("entity_id").alias("track_id"), "x1", "y1", "x2", "y2", "class")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, x1, y1, x2, y2, conf, class, homography, cut): what a detector finds: some are missing for one frame or for twelve, some unsure, some taken for a goalkeeper; the view is cut at halftime."""
    f, e = F.col("frame"), F.col("entity_id")
    people = _boxes(lens.tracking(spark, sf_dir).where("entity_id <> -1")).where((f + 40 * e) % 500 >= 12)
    shift = ((f * 7 + e * 11) % 5 - 2) / 2.0
    conf = F.when((f * 3 + e) % 7 == 0, 0.2).otherwise(0.6 + F.col("conf") * 0.4)
    kind = F.when((f + e) % 9 == 0, "goalkeeper").otherwise(F.col("class"))
    found = people.select("match_id", "frame", *((F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")), conf.alias("conf"), kind.alias("class"), F.array(*(F.lit(float(h)) for h in TO_PITCH.ravel())).alias("homography"))
    return found.join(lens.matches(spark, sf_dir).select("match_id", "halftime_frame"), "match_id").withColumn("cut", F.col("frame") == F.col("halftime_frame")).drop("halftime_frame")


def ball_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, x, y, conf): the ball's pixel in most frames, something like a ball in others, and a row without place in each frame."""
    f = F.col("frame")
    ball = lens.tracking(spark, sf_dir).where("entity_id = -1")
    u, v = project([F.lit(float(h)) for h in TO_PIXEL.ravel()], F.col("x"), F.col("y"))
    real = ball.where((f % 11 != 4) & (f % 400 >= 40)).select("match_id", "frame", u.alias("x"), v.alias("y"), (0.3 + (f * 13 % 50) / 100).alias("conf"))
    other = ball.where(f % 3 == 0).select("match_id", "frame", ((f * 17) % 1280).cast("double").alias("x"), ((f * 29) % 640).cast("double").alias("y"), (0.2 + (f * 19 % 60) / 100).alias("conf"))
    none = ball.select("match_id", "frame", *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "conf")))
    return real.unionByName(other).unionByName(none)


def homography_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, homography, cut, shift): estimates that shake by some decimetres, are mirrored, far off or missing in some frames; the view is cut at halftime."""
    f = F.col("frame")
    frames = lens.tracking(spark, sf_dir).where("entity_id = -1").join(lens.matches(spark, sf_dir), "match_id")
    rows = [[F.lit(float(v)) for v in r] for r in TO_PITCH]
    jx, jy = ((f * 37) % 21 - 10) / 50 + F.when(f % 97 == 50, 70.0).otherwise(0.0), ((f * 53) % 17 - 8) / 50
    along, across = [a + jx * c for a, c in zip(rows[0], rows[2])], [b + jy * c for b, c in zip(rows[1], rows[2])]
    mirrored = [F.when(f % 11 == 4, 105.0 * c - a).otherwise(a) for a, c in zip(along, rows[2])]
    estimate = F.when(f % 5 != 3, F.array(*mirrored, *across, *rows[2]))
    still = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.5, 0.0, 1.0, 0.0)))
    return frames.select("match_id", "frame", estimate.alias("homography"), (f == F.col("halftime_frame")).alias("cut"), F.when(f % 5 == 3, still).alias("shift"))


def colour_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, histogram): eight bins of what the view holds, other ones after halftime and in a replay each thousand frames."""
    f = F.col("frame")
    frames = lens.tracking(spark, sf_dir).where("entity_id = -1").join(lens.matches(spark, sf_dir), "match_id")
    other = (f >= F.col("halftime_frame")) != (f % 1000 >= 950)
    bins = [F.when(other, float((i * 5) % 8) ** 2).otherwise(float(i) ** 2) + (f * (i + 3)) % 4 for i in range(8)]
    return frames.select("match_id", "frame", F.array(*bins).alias("histogram"))


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, frame, u, v, x, y): matched pixels and places of six players of each tenth frame, a decimetre off; of every fifth of these frames four points on a line."""
    f, e = F.col("frame"), F.col("entity_id")
    seen = lens.tracking(spark, sf_dir).where((f % 10 == 0) & e.isin(1, 4, 7, 13, 16, 19))
    line = f % 50 == 0
    x, y = F.when(line, 10.0 * e).otherwise(F.col("x")), F.when(line, 3.0 * e).otherwise(F.col("y"))
    placed = seen.where(~line | e.isin(1, 4, 7, 13)).select("match_id", "frame", "entity_id", x.alias("x"), y.alias("y"))
    u, v = project([F.lit(float(h)) for h in TO_PIXEL.ravel()], F.col("x"), F.col("y"))
    off = F.when(f % 50 == 0, 0.0).otherwise(((f + e) % 3 - 1) / 10)
    return placed.select("match_id", "frame", "entity_id", u.alias("u"), v.alias("v"), (F.col("x") + off).alias("x"), "y")
