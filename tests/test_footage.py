"""Tables around footage and segments, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import homography, segments
from touchline.operators import footage
from touchline.sources import camera, lens

FOLDER = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head()


def test_segments_and_labels(spark):
    s = tuple(F.lit(float(v)) for v in (1, 2, 4, 6))
    level, point = tuple(F.lit(float(v)) for v in (1, 2, 4, 2)), tuple(F.lit(1.0) for _ in range(4))
    left = tuple(F.lit(float(v)) for v in (4, 2, 1, 2))
    got = one(spark, segments.length(s), segments.angle(s), segments.angle(left), segments.x_at(s, F.lit(4.0)), segments.x_at(level, F.lit(9.0)), segments.y_at(s, F.lit(4.0)), segments.distance_to(s, F.lit(1.0), F.lit(7.0)), segments.distance_to(point, F.lit(4.0), F.lit(5.0)), segments.angle_between(F.lit(175.0), F.lit(5.0)), segments.area(s), *segments.foot(s), *segments.centre(s))
    assert np.allclose(got, (5, np.degrees(np.arctan2(4, 3)), 0, 2.5, 2.5, 6, 3, 5, 10, 12, 2.5, 6, 2.5, 4))
    names = spark.createDataFrame([("Sports Ball",), ("GOALKEEPER_1",), ("football player",), ("person",), ("assistant referee",), ("tree",)], "n string")
    assert [r[0] for r in names.select(segments.class_of(F.col("n"))).collect()] == ["ball", "goalkeeper", "ball", "player", "referee", None]
    teams = spark.createDataFrame([("home", 9, 3), ("away", None, 3), ("none", 1, 3)], "t string, j int, e int").select(segments.other_team(F.col("t")).alias("o"), segments.player_label(F.col("e"), F.col("j"), F.col("t")).alias("l")).collect()
    assert [tuple(r) for r in teams] == [("away", "#9 (Home)"), ("home", "player 3 (Away)"), ("none", "#1 (None)")]


def test_pixels_go_back_to_their_places(spark):
    seen = lens.tracking(spark, FOLDER).where("frame < 30")
    frames = seen.select("match_id", "frame").distinct().where("frame <> 7").withColumn("homography", F.array(*(F.lit(float(v)) for v in camera.TO_PITCH.ravel())))
    rows = footage.with_pixels(seen, frames).collect()
    known = [r for r in rows if r["x_pixel"] is not None]
    assert len(rows) == seen.count() and all(r["x_pixel"] is None for r in rows if r["frame"] == 7) and len(known) > 500
    back = homography.apply(camera.TO_PITCH, np.array([[r["x_pixel"], r["y_pixel"]] for r in known]))
    assert np.allclose(back, [[r["x"], r["y"]] for r in known], atol=1e-6)
    assert all(-200 < r["x_pixel"] < 1300 and -100 < r["y_pixel"] < 700 for r in known)
    error = footage.calibration_errors(camera.true_boxes(spark, FOLDER).where("frame < 30"), seen, frames).head()
    assert error["n"] > 500 and error["p90_m"] < 1e-6


def test_strides_windows_and_sweeps(spark):
    frames = spark.range(10).select(F.lit("m1").alias("match_id"), F.col("id").cast("int").alias("frame"))
    assert [r["frame"] for r in footage.strided(frames, 25.0, 8.0).collect()] == [0, 3, 6, 9] and footage.strided(frames, 25.0, 60.0).count() == 10
    boxes = spark.createDataFrame([("m1", f, t, 10.0 * t, 0.0, 10.0 * t + s, float(s)) for f in range(0, 10, 2) for t, s in ((1, 40), (2, 4))], "match_id string, frame int, track_id int, x1 double, y1 double, x2 double, y2 double")
    got = [(r["frame"], r["first"], r["second"], r["x"], r["y"]) for r in footage.ball_windows(boxes, frames, 100.0, 50.0).orderBy("frame").collect()]
    assert got == [(f, f - 2, f - 1, *((0.22, 0.04) if f % 2 == 0 else (None, None))) for f in range(2, 10)]
    peaks = spark.createDataFrame([(0.9, 3.0, 4.0, True, 0.0, 0.0), (0.4, 0.0, 0.0, True, 0.0, 0.0), (0.6, 1.0, 1.0, False, None, None), (0.1, 1.0, 1.0, False, None, None)], "peak double, x double, y double, has boolean, true_x double, true_y double")
    rows = {r["threshold"]: tuple(r)[1:] for r in footage.threshold_sweep(peaks, (0.3, 0.5, 0.95)).collect()}
    assert rows == {0.3: (2, 2, 1.0, 0.5, 2.5, pytest.approx(0.4875)), 0.5: (2, 2, 0.5, 0.5, 5.0, pytest.approx(-0.025)), 0.95: (2, 2, 0.0, 0.0, None, -0.1)}


def test_poses(spark):
    def body(unsure=()):
        points = [(50.0, 10.0 + 6 * i, 0.1 if i in unsure else 0.9) for i in range(17)]
        points[5], points[6] = (40.0, 20.0, points[5][2]), (60.0, 20.0, points[6][2])
        points[11], points[12] = (45.0, 60.0, points[11][2]), (55.0, 60.0, points[12][2])
        points[9], points[10] = (30.0, 40.0, points[9][2]), (70.0, 40.0, points[10][2])
        points[15], points[16] = (40.0, 100.0, points[15][2]), (60.0, 100.0, points[16][2])
        return points

    rows = [("m1", 1, f, body(), 0.0, 100.0) for f in range(2)] + [("m1", 1, 2, body((15, 9)), 0.0, 100.0), ("m1", 2, 0, body((5,)), 0.0, 100.0), ("m1", 3, 0, body(), 0.0, 100.0)]
    found = footage.pose_descriptors(spark.createDataFrame(rows, "match_id string, entity_id int, frame int, keypoints array<struct<x:double,y:double,conf:double>>, y1 double, y2 double"))
    first = found.where("entity_id = 1 and frame = 0").head()
    assert np.allclose([first["lean"], first["stride"], first["arm_spread"], first["crouch"]], (0, 0.2, 2.0, 0.4), atol=1e-6)
    points = np.array([p[:2] for p in body()])
    assert np.isclose(first["compact"], np.linalg.norm(points - points.mean(axis=0), axis=1).mean() / 100)
    unsure = found.where("entity_id = 1 and frame = 2").head()
    assert unsure["stride"] is None and unsure["arm_spread"] is None and unsure["crouch"] is None and found.where("entity_id = 2").count() == 0
    profile = footage.pose_profiles(found).collect()
    assert [(r["entity_id"], r["n_samples"]) for r in profile] == [(1, 3)] and np.isclose(profile[0]["stride_mean"], 0.2) and profile[0]["stride_std"] == 0


def test_top_pairs(spark):
    pairs = spark.createDataFrame([("m1", i, i + 1, float(i // 2)) for i in range(20)], "match_id string, defender_id int, attacker_id int, share double")
    assert [r["defender_id"] for r in footage.top_pairs(pairs).orderBy("place").collect()] == [18, 19, 16, 17, 14, 15]
