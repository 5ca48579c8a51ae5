"""Matches of any id, frame rate and pitch; the nearest ball; threat from shots; trust in perception."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import DEFAULT, of_match
from touchline.functions.assignment import hull, outer
from touchline.operators import control, embedding, formations, movement, passing, play, possession, tactics, tracks, trust
from touchline.sources import lens

FOLDER = "/root/testdata/sf0.001"
EVENTS = "match_id string, frame int, type string, team string, from_id int, to_id int, x double, y double, end_x double, end_y double, outcome string"


def test_metadata_gives_frame_rate_and_pitch():
    cfg = of_match({"fps": 30.0, "pitch_length": 100.0, "pitch_width": 64.0})
    assert (cfg.fps, cfg.pitch.length, cfg.pitch.width, cfg.pitch.box_depth) == (30.0, 100.0, 64.0, 16.5)
    assert of_match({"fps": None}) == DEFAULT


@pytest.fixture(scope="module")
def small(spark):
    """The derived match squeezed to 100 x 64 metres at thirty frames a second."""
    seen = lens.tracking(spark, FOLDER)
    seen = seen.select(F.lit("m1").alias("match_id"), "frame", (F.col("frame") / 30).alias("timestamp"), "entity_id", "class", "team", "jersey_no", (F.col("x") / 1.05).alias("x"), (F.col("y") * 64 / 68).alias("y"), "conf").cache()
    return seen, lens.matches(spark, FOLDER).select(F.lit("m1").alias("match_id"), "home_sign", "halftime_frame"), of_match({"fps": 30.0, "pitch_length": 100.0, "pitch_width": 64.0})


def test_operators_take_the_config_of_the_match(small):
    seen, matches, cfg = small
    held = possession.possession(seen, cfg).cache()
    found = play.events(seen, held, cfg).cache()
    kin = movement.kinematics(seen, cfg).cache()
    n = seen.select("frame").distinct().count()
    minutes = movement.minutes_played(seen, cfg).agg(F.max("minutes")).head()[0]
    assert 0.9 * n / 30 / 60 <= minutes <= n / 30 / 60
    # two frames of one entity are a thirtieth of a second apart
    row = kin.where("entity_id = 3 and frame between 100 and 102").orderBy("frame").collect()
    assert np.isclose(row[1]["vx"], (row[2]["x"] - row[0]["x"]) / 2 * 30)
    grid = passing.xt_grids(found, matches, cfg).orderBy("cell").collect()
    assert len(grid) == 192 and {r["match_id"] for r in grid} == {"m1"} and grid[6 * 16 + 15]["xt"] > 3 * grid[6 * 16]["xt"]
    surface = control.mean_control(control.every_nth_frame(kin.join(movement.minutes_played(seen, cfg).select("match_id", "entity_id", "team"), ["match_id", "entity_id"]), 200))
    assert surface.count() == 52 * 34
    maps = embedding.player_maps(seen, matches, cfg).groupBy("entity_id").agg(F.sum("v").alias("s"), F.max("ix").alias("ix")).collect()
    assert all(np.isclose(r["s"], 1) and r["ix"] <= 23 for r in maps)
    assert formations.window_places(seen, held, matches, 10, cfg).count() % 10 == 0
    assert tactics.phases(seen, held, matches, cfg).count() == held.count() and tracks.quality(seen, cfg).count() == 1


def test_the_nearest_ball_is_the_earlier_of_two(spark):
    rows = [("m1", f, 1, "player", "home", 0.0, 0.0) for f in range(10)] + [("m1", f, -1, "ball", "none", float(f), 0.0) for f in (2, 6)] + [("m2", 0, 1, "player", "home", 0.0, 0.0)]
    seen = spark.createDataFrame(rows, "match_id string, frame int, entity_id int, class string, team string, x double, y double")
    got = {r["frame"]: r["ball_frame"] for r in play.nearest_ball(seen).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 6, 6: 6, 7: 6, 8: 6, 9: 6}


def test_releases_are_found_without_a_ball_row(spark):
    """The ball goes from 1 to 2; it is not seen in frames 18 to 24, and player 1 stands by it until frame 20."""
    rows = []
    for f in range(60):
        rows += [("m1", f, 1, "player", "home", 0.0, 0.0), ("m1", f, 2, "player", "home", 30.0, 0.0)]
        if not 18 <= f <= 24:
            rows.append(("m1", f, -1, "ball", "none", 0.5 if f < 18 else min(30.5, 0.5 + 3 * (f - 20)), 0.0))
    seen = spark.createDataFrame(rows, "match_id string, frame int, entity_id int, class string, team string, x double, y double")
    held = possession.possession(seen)
    inside = {r["frame"]: round(r["d"], 3) for r in play.held_rows(seen, held).where("holder_id = 1").collect()}
    assert {18, 20} <= set(inside) and inside[20] == 0.5 and inside[21] == 0.5 and inside[22] > 10
    passes = play.events(seen, held).where("type = 'pass'").collect()
    assert [(p["frame"], p["from_id"], p["to_id"], p["x"]) for p in passes] == [(21, 1, 2, 0.5)]


def test_shots_and_goals_raise_threat_where_they_are_taken(spark):
    matches = spark.createDataFrame([(m, 1, 10_000) for m in ("plain", "shots", "goals")], "match_id string, home_sign int, halftime_frame int")
    passes = [(m, f, "pass", "home", 1, 2, 30.0, 34.0, 60.0, 34.0, "complete") for m in ("plain", "shots", "goals") for f in range(30)]
    shots = [(m, 100 + f, "shot", "home", 1, -1, 80.0, 34.0, 105.0, 34.0, "goal" if m == "goals" else "saved") for m in ("shots", "goals") for f in range(12)]
    events = spark.createDataFrame(passes + shots, EVENTS)
    assert {tuple(r) for r in passing.shot_counts(events, matches).collect()} == {("shots", 6 * 16 + 12, 12, 0), ("goals", 6 * 16 + 12, 12, 12)}
    grids = passing.xt_grids(events, matches)
    at = {r["match_id"]: r["xt"] for r in grids.where("cell = 108").collect()}
    assert at["goals"] > at["shots"] and at["goals"] > 2 * at["plain"]
    # by hand: the iteration that the equation solves
    t = DEFAULT.threat
    n = t.nx * t.ny
    table, tried, scored = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    table[6 * 16 + 4, 6 * 16 + 9], tried[108], scored[108] = 30, 12, 12
    x = (np.arange(n) % 16 + 0.5) * 105 / 16
    y = (np.arange(n) // 16 + 0.5) * 68 / 12
    ahead, far = x[None] - x[:, None], np.hypot(x[None] - x[:, None], y[None] - y[:, None])
    prior = np.exp(-far / 18) * np.exp(np.clip(ahead, -30, 30) / 45)
    np.fill_diagonal(prior, 0)
    moving = table + 2 * prior / prior.sum(axis=1, keepdims=True)
    goal = np.hypot(105 - x, 34 - y)
    shoots = (tried + 8 * 0.15 * np.clip(0.9 - goal / 40, 0.01, 0.85)) / (table.sum(axis=1) + tried + 8)
    scores = (scored + 3 * np.clip(0.55 - goal / 45, 0.02, 0.5)) / (tried + 3)
    v = np.zeros(n)
    for _ in range(300):
        v = shoots * scores + (1 - shoots) * 0.95 * (moving / moving.sum(axis=1, keepdims=True) @ v)
    got = [r["xt"] for r in grids.where("match_id = 'goals'").orderBy("cell").collect()]
    assert np.allclose(got, v, atol=1e-6)
    stored = spark.createDataFrame([("plain", c, 0.5) for c in range(n)] + [("shots", c, 0.5) for c in range(5)], "match_id string, cell int, xt double")
    best = {r["match_id"]: (r["c"], round(r["s"], 6)) for r in passing.stored_or_fitted(stored, grids).groupBy("match_id").agg(F.count("*").alias("c"), F.sum("xt").alias("s")).collect()}
    assert {m: c for m, (c, _) in best.items()} == {"plain": n, "shots": n, "goals": n} and best["plain"][1] == n / 2 and best["shots"][1] != n / 2


@pytest.mark.parametrize("source,level", [("video:x", "low"), ("simulator", "high"), (None, "high")])
def test_trust_grades_what_is_missing_as_low(spark, source, level):
    seen = spark.createDataFrame([("m1", f, e, 0.9) for f in range(200) for e in (*range(10), -1)], "match_id string, frame int, entity_id int, conf double")
    none = spark.createDataFrame([], "match_id string, frame int, h00 double, method string, reproj_error_px double")
    matches = spark.createDataFrame([("m1", source, 25.0, 200, None, None)], "match_id string, source string, fps double, n_frames int, team_separability double, ball_observed_frames long")
    r = trust.perception_quality(seen, none, matches).head()
    assert (r["overall"], r["calibration_level"], r["teams_level"]) == (level,) * 3 and r["tracks_level"] == r["ball_level"] == "high"
    wanted = "calibrated in 0% of frames; 10 players in view; kits are hard to tell apart" if level == "low" else "positions are exact"
    assert r["notes"] == wanted and r["error_px"] is None and r["ball_seen_share"] == 1.0


def test_outer_points_keep_the_hull():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 500):
        for _ in range(20):
            points = rng.normal(0, 10, (n, 2)).round(1)
            assert np.array_equal(hull(points), hull(outer(points)))
    line = np.stack([np.arange(90.0), np.arange(90.0)], axis=1)
    assert np.array_equal(hull(line), hull(outer(line)))


@pytest.mark.parametrize("name,most", [("line_breaking_passes", 6), ("xt_grid", 4), ("player_xt", 6), ("pass_agreement", 4), ("pass_summary", 2)])
def test_events_read_more_than_once_are_computed_once(spark, name, most):
    """The given frames are read anew by each branch that computes events; stored events leave few reads."""
    from touchline.plans.queries import QUERIES

    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") <= most


def test_marking_scores_read_stored_assignments_and_phases(spark):
    """Pairs, stability and coupling share the assignments, which need the motion of all players."""
    from touchline.plans.queries import QUERIES

    plan = QUERIES["marking_scores"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Relation [o_orderkey") <= 4


def test_matches_are_dealt_to_as_many_tasks_as_their_frames_need(spark, monkeypatch):
    # a task would get more frames, the larger the tables are, and sort them on disk
    monkeypatch.setattr(lens, "TASK_FRAMES", 1000)
    before = spark.conf.get(lens.TASKS, None)
    try:
        lens.keep_matches(spark, "/root/testdata/sf0.01")
        assert lens.tracking(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 15
        monkeypatch.setattr(lens, "TASK_FRAMES", 10**9)
        lens.keep_matches(spark, "/root/testdata/sf0.01")
        assert lens.tracking(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(lens.TASKS) if before is None else spark.conf.set(lens.TASKS, before)


def test_clusters_of_players_are_found_in_as_many_tasks_as_shuffles_have(spark):
    # a few bytes a match were all put into one task
    rng = np.random.default_rng(4)
    rows = [(m, e, rng.normal(size=16).tolist()) for m in range(40) for e in range(8)]
    found = embedding.style_clusters(spark.createDataFrame(rows, "match_id int, entity_id int, vector array<double>"), 3)
    used = found.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert found.count() == len(rows) and used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_queries_use_no_generated_methods_that_java_would_interpret(spark):
    # poses were described in one method of more than 8000 bytes, which took five times as long
    from touchline.plans import queries

    assert queries.QUERIES["pose_profiles"](spark, FOLDER).count() > 0
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_boxes_are_not_sorted_to_find_the_ball(spark, capsys):
    from touchline.operators import footage

    boxes = spark.createDataFrame([(1, f, t, 0.0, 0.0, 1.0 + t, 1.0) for f in range(4) for t in (5, 7)], "match_id int, frame int, track_id int, x1 double, y1 double, x2 double, y2 double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = footage.ball_windows(boxes, boxes, 10.0, 10.0)
        found.explain()
        assert "BroadcastHashJoin [match_id" in capsys.readouterr().out
        assert [r["x"] for r in found.orderBy("frame").collect()] == [0.3, 0.3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_ghosts_compute_the_motion_once_and_sort_it_once(spark):
    """Smoothing took a dozen windows of two orders, and the last frame of a match computed the motion anew."""
    from touchline.plans.queries import QUERIES

    plan = QUERIES["offscreen_ghosts"](spark, FOLDER)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Generate explode(sequence") == 2
    # the gaps' window, groups of an entity, the ghosts' window
    assert plan.sparkPlan().toString().count("FlatMapGroupsInArrow") == 1 and plan.sparkPlan().toString().count("Window [") == 3


def test_outer_points_of_waves_are_few():
    """The farthest point in the last direction may be that in the first, which kept all points."""
    f = np.arange(6000)
    for sx, sy, ph in ((7, 4, 12345), (24, 17, 777), (13, 9, 40000)):
        points = np.stack([np.abs((f * sx + ph) % 21000 - 10500) / 100, np.abs((f * sy + 5 * ph) % 13600 - 6800) / 100], axis=1)
        assert len(outer(points)) < 3500 and np.array_equal(hull(points), hull(outer(points)))
    assert outer(np.zeros((0, 2))).shape == (0, 2)


def test_hull_areas_of_many_players(spark):
    """Tasks and their number do not change the areas; three rows or rows on a line have none."""
    from touchline.functions.assignment import hull_area
    from touchline.operators.features import hull_areas

    rng = np.random.default_rng(5)
    rows = [(m, e, float(x), float(y)) for m in range(3) for e in range(5) for x, y in rng.normal(0, 10, (3 if e == 4 else 50, 2)).round(2)]
    points = spark.createDataFrame(rows, "match_id int, entity_id int, xa double, ya double").repartition(7)
    found = {(r["match_id"], r["entity_id"]): r["hull_area"] for r in hull_areas(points).collect()}
    want = {(m, e): hull_area(np.array([r[2:] for r in rows if r[:2] == (m, e)]), 4) for m in range(3) for e in range(5)}
    assert found.keys() == want.keys() and all(np.isclose(found[k], want[k]) for k in want)
    plan = hull_areas(points)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan


def test_marked_motion_has_the_profiles_of_sorted_motion(spark):
    """Sprints and turns that are marked while an entity's rows are in order count as those found by windows, over runs, null speeds and turns across half a circle."""
    rng, rows = np.random.default_rng(2), []
    for e in range(4):
        x, y, way = 50.0, 30.0, 0.0
        for f in range(900):
            if e == 3 and 300 <= f < 340:
                continue
            way, v = way + rng.normal(0, 0.4), (9.0 if f // 60 % 2 else 2.0) + (6.0 if f % 200 == 150 else 0.0)
            x, y = x + v / 25 * np.cos(way * (e > 0)), y + v / 25 * np.sin(way * (e > 0))
            dx, dy = rng.normal(0, 1.5, 2) * (e == 2)
            rows.append((0, f, e, "player", "home", float(x + dx), float(y + dy)))
    seen = spark.createDataFrame(rows, "match_id int, frame int, entity_id int, class string, team string, x double, y double")
    plain, marked = (sorted(map(tuple, movement.movement_profiles(movement.kinematics(seen, marks=m)).collect())) for m in (False, True))
    assert [r[7] for r in plain] == [r[7] for r in marked] and [r[9] for r in plain] == [r[9] for r in marked] and any(r[7] for r in plain) and any(r[9] for r in plain)
    assert np.allclose(plain, marked)
