"""Tables around footage: strides, pixels of known places, errors of calibration, windows of the ball, poses."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pitch import project
from ..functions.segments import foot
from ..functions.sequences import ordered

#: Pixels that still count as near the image.
NEAR_X, NEAR_Y = (-200.0, 1300.0), (-100.0, 700.0)


def strided(frames: DataFrame, source_fps: float, target_fps: float) -> DataFrame:
    """Every n-th frame so that about ``target_fps`` are left; never more than there are."""
    return frames.where(F.col("frame") % max(1, round(source_fps / target_fps)) == 0)


def inverse(h: list[Column]) -> list[Column]:
    """The inverse of nine coefficients up to a factor, which a projection doesn't see."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def with_pixels(tracking: DataFrame, homographies: DataFrame) -> DataFrame:
    """Rows with x_pixel and y_pixel of their places by the frame's homography (array of nine); null far outside the image and in frames without one."""
    joined = tracking.drop("x_pixel", "y_pixel").join(homographies.select("match_id", "frame", "homography"), ["match_id", "frame"], "left")
    u, v = project(inverse([F.get("homography", F.lit(k)) for k in range(9)]), F.col("x"), F.col("y"))
    near = (u > NEAR_X[0]) & (u < NEAR_X[1]) & (v > NEAR_Y[0]) & (v < NEAR_Y[1])
    return joined.withColumns({"x_pixel": F.when(near, u), "y_pixel": F.when(near, v)}).drop("homography")


def calibration_errors(boxes: DataFrame, places: DataFrame, homographies: DataFrame) -> DataFrame:
    """(match_id, n, mean_m, median_m, p90_m): how far true boxes' feet, through the frame's homography, are from the true places of the same entities."""
    feet = boxes.select("match_id", "frame", F.col("track_id").alias("entity_id"), *(c.alias(n) for c, n in zip(foot(tuple(map(F.col, ("x1", "y1", "x2", "y2")))), ("u", "v"))))
    joined = feet.join(places.select("match_id", "frame", "entity_id", "x", "y"), ["match_id", "frame", "entity_id"]).join(homographies.where("homography is not null").select("match_id", "frame", "homography"), ["match_id", "frame"])
    px, py = project([F.get("homography", F.lit(k)) for k in range(9)], F.col("u"), F.col("v"))
    off = joined.select("match_id", F.hypot(px - F.col("x"), py - F.col("y")).alias("off"))
    return off.groupBy("match_id").agg(F.count("off").alias("n"), F.avg("off").alias("mean_m"), F.percentile("off", 0.5).alias("median_m"), F.percentile("off", 0.9).alias("p90_m"))


def ball_windows(boxes: DataFrame, frames: DataFrame, width: float, height: float) -> DataFrame:
    """(match_id, frame, first, second, x, y): each frame with the two before it, and where the ball is in it as shares of the image; null where it has no box.

    The ball is the track of the smallest median area, the least id on ties.
    """
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    medians = boxes.groupBy("match_id", "track_id").agg(F.percentile(size, 0.5).alias("area"))
    ball = medians.groupBy("match_id").agg(F.min(F.struct("area", "track_id"))["track_id"].alias("track_id"))
    # a row a match goes to all tasks, so that no box is shuffled for it
    own = boxes.join(F.broadcast(ball), ["match_id", "track_id"]).select("match_id", "frame", ((F.col("x1") + F.col("x2")) / 2 / width).alias("x"), ((F.col("y1") + F.col("y2")) / 2 / height).alias("y"))
    order = ordered("match_id")
    placed = frames.select("match_id", "frame").distinct().withColumns({"first": F.lag("frame", 2).over(order), "second": F.lag("frame", 1).over(order)}).where("first is not null")
    return placed.join(own, ["match_id", "frame"], "left")


def threshold_sweep(peaks: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, n_pos, n_neg, detected, false_alarms, median_px, score) of a detector's peaks (peak, x, y, has, true_x, true_y) at each threshold."""
    at = peaks.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    has, hit = F.col("has"), F.col("peak") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    off = F.when(has & hit, F.hypot(F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y")))
    sums = at.groupBy("threshold").agg(n(has).alias("n_pos"), n(~has).alias("n_neg"), n(has & hit).alias("hits"), n(~has & hit).alias("alarms"), F.percentile(off, 0.5).alias("median_px"))
    rates = sums.withColumns({"detected": F.col("hits") / F.greatest("n_pos", F.lit(1)), "false_alarms": F.col("alarms") / F.greatest("n_neg", F.lit(1))})
    cost = F.coalesce(F.least("median_px", F.lit(20.0)) / 200, F.lit(0.1))
    return rates.select("threshold", "n_pos", "n_neg", "detected", "false_alarms", "median_px", (F.col("detected") - F.col("false_alarms") - cost).alias("score"))


POSE = ("lean", "stride", "arm_spread", "crouch", "compact")
#: Keypoints of a pose.
POINTS = 17


def pose_descriptors(poses: DataFrame, least: float = 0.3) -> DataFrame:
    """(match_id, entity_id, frame, lean, stride, arm_spread, crouch, compact) of seventeen keypoints (x, y, conf) in a box: angles and lengths over its height; rows whose shoulders or hips are unsure go, parts that are unsure are null."""
    k = lambda i, c: F.get("keypoints", F.lit(i))[c]
    sure = lambda *at: F.least(*(k(i, "conf") for i in at)) >= least
    mid = lambda a, b, c: (k(a, c) + k(b, c)) / 2
    gap = lambda a, b: F.hypot(k(a, "x") - k(b, "x"), k(a, "y") - k(b, "y"))
    h = F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-6))
    lean = F.abs(F.atan2(mid(11, 12, "x") - mid(5, 6, "x"), mid(11, 12, "y") - mid(5, 6, "y") + 1e-9))
    # sums are written out point by point: functions over arrays are interpreted, element by element, for every row
    total = lambda of: reduce(add, (F.when(k(i, "conf") >= least, of(i)).otherwise(0.0) for i in range(POINTS)), F.lit(0.0))
    n = total(lambda i: F.lit(1.0))
    rows = poses.where(sure(5, 6, 11, 12)).withColumns({"n": n, "mx": total(lambda i: k(i, "x")) / n, "my": total(lambda i: k(i, "y")) / n})
    spread = total(lambda i: F.hypot(k(i, "x") - F.col("mx"), k(i, "y") - F.col("my"))) / F.col("n")
    ankle = F.hypot(mid(15, 16, "x") - mid(11, 12, "x"), mid(15, 16, "y") - mid(11, 12, "y"))
    return rows.select(
        "match_id", "entity_id", "frame", lean.alias("lean"), F.when(sure(15, 16), gap(15, 16) / h).alias("stride"),
        F.when(sure(9, 10), gap(9, 10) / F.greatest(gap(5, 6), F.lit(1e-6))).alias("arm_spread"), F.when(sure(15, 16), ankle / h).alias("crouch"), (spread / h).alias("compact"),
    )


def pose_profiles(descriptors: DataFrame, fewest: int = 3) -> DataFrame:
    """(match_id, entity_id, n_samples, mean and std of each descriptor) of tracks with enough clean poses; 0 where a part was never sure."""
    stats = [F.coalesce(of(n), F.lit(0.0)).alias(f"{n}_{kind}") for n in POSE for of, kind in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return descriptors.groupBy("match_id", "entity_id").agg(F.count("*").alias("n_samples"), *stats).where(F.col("n_samples") >= fewest)


def top_pairs(pairs: DataFrame, share: str = "share", k: int = 6) -> DataFrame:
    """The k rows of the largest share in each match, with their place; ties go by ids."""
    ids = [c for c in pairs.columns if c.endswith("_id") and c != "match_id"]
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.round(share, 9)), *ids))
    return pairs.withColumn("place", place).where(F.col("place") <= k)
