"""Constructed scenes with known answers, kernels against enumeration, and every query against its SQL twin."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from touchline.config import DEFAULT
from touchline.functions import conics, direction, pitch
from touchline.functions.assignment import assign, hull_area
from touchline.operators import control, formations, marking, movement, passing, play, possession, tactics, tracks
from touchline.plans import oracle, queries
from touchline.sources import formats, lens

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "match_id int, frame int, timestamp double, entity_id int, class string, team string, jersey_no smallint, x double, y double, conf double"


def row(frame, entity, team, x, y):
    return (0, frame, frame / 25, entity, "ball" if entity == -1 else "player", team, None, float(x), float(y), 1.0)


@pytest.fixture(scope="module")
def pass_chain(spark):
    """The ball goes from player 1 to 2 of the home team and is then lost to 3."""
    rows = []
    for f in range(200):
        for e, t, x, y in ((1, "home", 30, 30), (2, "home", 50, 40), (3, "away", 60, 20)):
            rows.append(row(f, e, t, x, y))
        if f < 50:
            bx, by = 30.5, 30
        elif f < 75:
            bx, by = 30 + 20 * (f - 50) / 25, 30 + 10 * (f - 50) / 25
        elif f < 140:
            bx, by = 50.5, 40
        elif f < 160:
            bx, by = 50 + 10 * (f - 140) / 20, 40 - 20 * (f - 140) / 20
        else:
            bx, by = 60.5, 20
        rows.append(row(f, -1, "none", bx, by))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_possession_follows_the_ball(pass_chain):
    held = possession.possession(pass_chain)
    spells = possession.spells(held).orderBy("start_frame").collect()
    assert [s["holder_id"] for s in spells] == [1, 2, 3] and spells[0]["start_frame"] == 0
    found = play.events(pass_chain, held).collect()
    assert sorted((e["type"], e["outcome"]) for e in found) == [("pass", "complete"), ("pass", "intercepted"), ("turnover", "interception")]
    assert next(e for e in found if e["type"] == "turnover")["team"] == "away"


def test_possession_matches_a_loop(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    holder, cand, run = -1, -1, 0
    for f in range(400):
        e, d = int(rng.integers(1, 4)), float(rng.choice([1.0, 5.0], p=[0.85, 0.15]))
        if f % 12:
            e = rows[-2][3]
        rows += [row(f, e, "home", 50, 30), row(f, -1, "none", 50 + d, 30)]
        now = e if d <= 2 else -1
        run = run + 1 if now == cand else 1
        cand = now
        if now != -1 and (holder == -1 or run == 6):
            holder = now
        want.append(holder)
    got = possession.possession(spark.createDataFrame(rows, SCHEMA)).orderBy("frame").collect()
    assert [r["holder_id"] for r in got] == want


def test_constant_speed_and_one_sprint(spark):
    rows, x = [], 0.0
    for f in range(150):
        rows.append(row(f, 1, "home", 10 + 4 * f / 25, 30))
    for f in range(200):
        x += (8 if 80 <= f < 120 else 2) / 25
        rows.append(row(f, 2, "home", x, 40))
    profile = {r["entity_id"]: r for r in movement.movement_profiles(movement.kinematics(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert abs(profile[1]["mean_speed"] - 4) < 1e-6 and profile[1]["n_sprints"] == 0 and abs(profile[1]["distance_m"] - 24) < 0.5
    assert profile[2]["n_sprints"] == 1 and profile[2]["top_speed"] > 7


def test_smoothing_keeps_quadratics(spark):
    rows = [row(f, 1, "home", 1 + 0.1 * f + 0.002 * f * f, 30 - 0.05 * f) for f in range(40)]
    smooth = movement.smoothed(movement.resampled(spark.createDataFrame(rows, SCHEMA))).orderBy("frame").collect()
    assert np.allclose([r["x"] for r in smooth], [r[7] for r in rows]) and np.allclose([r["y"] for r in smooth], [r[8] for r in rows])


def test_control_leans_to_the_nearer_team(spark):
    home, away = np.array([[[40.0, 34.0], [np.nan, np.nan]]]), np.array([[[65.0, 34.0]]])
    value = control.control_surface(home, away)[0]
    assert value.shape == (34, 52) and value[17, 19] > 0.9 and value[17, 32] < 0.1 and 0.35 < value[17, 26] < 0.65
    assert (control.control_surface(home[:, :0], away) == 0.5).all()
    near = np.hypot(*np.meshgrid((np.arange(52) + 0.5) * 105 / 52 - 40, (np.arange(34) + 0.5) * 2 - 34)) / 7.8
    far = np.hypot(*np.meshgrid((np.arange(52) + 0.5) * 105 / 52 - 65, (np.arange(34) + 0.5) * 2 - 34)) / 7.8
    assert np.allclose(value, 1 / (1 + np.exp((near - far) / 0.45)))


def test_control_needs_six_players(spark):
    rows = [(m, f, "home" if i % 2 else "away", 10.0 * i, 30.0, 0.0, 0.0) for m in (0, 1) for f in (0, 5) for i in range(6 if f == 0 else 5)]
    moving = spark.createDataFrame(rows, "match_id int, frame int, team string, x double, y double, vx double, vy double")
    assert {(r["match_id"], r["frame"]) for r in control.control_frames(moving).collect()} == {(0, 0), (1, 0)}
    mean = control.mean_control(moving)
    assert mean.count() == 2 * 52 * 34 and mean.groupBy("iy", "ix").agg(F.count_distinct("home").alias("n")).where("n <> 1").count() == 0


def test_every_nth_distinct_frame(spark):
    rows = [(0, e, 3 * f) for f in range(30) for e in range(2)]
    found = control.every_nth_frame(spark.createDataFrame(rows, "match_id int, entity_id int, frame int"), 12)
    assert sorted((r["frame"], r["entity_id"]) for r in found.collect()) == [(f, e) for f in (0, 36, 72) for e in (0, 1)]


def test_direction_follows_the_match_table(spark):
    matches = spark.createDataFrame([(0, 1, 50), (1, -1, 10), (2, None, None)], "match_id int, home_sign int, halftime_frame int")
    rows = spark.createDataFrame([(m, t, f) for m in (0, 1, 2, 3) for t in ("home", "away", "none") for f in (0, 10, 50)], "match_id int, team string, frame int")
    found = {(r["match_id"], r["team"], r["frame"]): r["s"] for r in direction.directed(rows, matches).withColumn("s", direction.sign()).collect()}
    assert [found[0, "home", f] for f in (0, 10, 50)] == [1, 1, -1] and [found[1, "home", f] for f in (0, 10, 50)] == [-1, 1, 1]
    assert all(found[m, "home", f] == 1 and found[m, "away", f] == -1 for m in (2, 3) for f in (0, 10, 50))
    assert all(found[m, "away", f] == -found[m, "home", f] and found[m, "none", f] is None for m in range(4) for f in (0, 10, 50))
    meta = spark.createDataFrame([("a", {"home": -1}, '{"halftime_frame": 7}'), ("b", {}, None)], "match_id string, attack_direction map<string,int>, extras string")
    assert sorted(tuple(r) for r in direction.matches_of(meta).collect()) == [("a", -1, 7), ("b", 1, None)]


def test_formation_templates_match_themselves():
    for name in formations.FORMATIONS:
        for sign in (1, -1):
            own = formations.formation_slots(name, attack_sign=sign)
            found, cost, labels = formations.match_formation(own if sign > 0 else np.array([105.0, 68.0]) - own)
            assert (found, labels) == (name, formations.template(name)[1]) and cost < 1e-9
    with pytest.raises(KeyError):
        formations.formation_slots("9-0-1")


def test_threat_is_the_fixed_point_of_its_equation():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.2, (192, 192)).astype(float)
    grid = passing.value_grid(counts, 0.8)
    assert grid.shape == (192,) and (grid > 0).all() and (grid < 1).all()
    plain = passing.value_grid(np.zeros((192, 192)), None).reshape(12, 16)
    assert np.allclose(plain, plain[::-1]) and plain[6, 15] > plain[6, 8] > plain[6, 0]


def test_voronoi_areas_of_every_frame(spark):
    rows = queries.QUERIES["voronoi_areas"](spark, FOLDER)
    seen = possession.players_only(lens.tracking(spark, FOLDER)).select("match_id", "frame").distinct()
    assert rows.count() == seen.count() and rows.where("frame % 25 <> 0").count() > 0


def test_clipped_area_matches_a_grid():
    points = np.random.default_rng(3).uniform((0, 0), (105, 68), (22, 2))
    points[21] = points[20]
    areas = [control.clipped_area(points, i, 105.0, 68.0) for i in range(22)]
    x, y = np.meshgrid((np.arange(1050) + 0.5) / 10, (np.arange(680) + 0.5) / 10)
    nearest = ((x[..., None] - points[:21, 0]) ** 2 + (y[..., None] - points[:21, 1]) ** 2).argmin(-1)
    assert np.abs(np.bincount(nearest.ravel(), minlength=21) / 100 - areas[:21]).max() < 2
    assert abs(sum(areas[:21]) - 105 * 68) < 1e-6 and areas[20] == areas[21]


def test_voronoi_square(spark):
    rows = [(0, 0, t, x, y) for t, x, y in (("home", 26.25, 17.0), ("home", 26.25, 51.0), ("away", 78.75, 17.0), ("away", 78.75, 51.0))]
    found = control.voronoi_areas(spark.createDataFrame(rows, "match_id int, frame int, team string, x double, y double")).head()
    assert np.isclose(found["home_area"], 3570) and np.isclose(found["away_area"], 3570)


def test_ghosts_until_the_horizon(spark):
    rows = [(0, 1, f, 10.0, 10.0, 1.0, 0.0) for f in range(10)] + [(0, 2, f, 20.0, 10.0, 0.0, 0.0) for f in range(60)]
    found = control.ghosts(spark.createDataFrame(rows, "match_id int, entity_id int, frame int, x double, y double, vx double, vy double")).where("ghost").collect()
    assert len(found) == 25 and max(r["frame"] for r in found) == 34


def test_assignment_against_enumeration():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            rows, cols = assign(cost)
            wide = cost if n <= m else cost.T
            best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
            assert len(rows) == min(n, m) == len(set(rows)) == len(set(cols)) and cost[rows, cols].sum() == best


def test_hull_area():
    assert hull_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]])) == 4
    assert hull_area(np.array([[0, 0], [1, 1], [2, 2]])) == 0 and hull_area(np.array([[0, 0], [1, 0]])) == 0


@pytest.mark.parametrize("name", formations.FORMATIONS)
def test_formations_are_recovered(name):
    rng = np.random.default_rng(7)
    places, _ = formations.template(name)
    assert formations.match_formation(places * [105, 68] + rng.normal(0, 0.5, (10, 2)))[0] == name


def test_threat_rises_towards_the_goal():
    grid = passing.value_grid(np.zeros((192, 192)), None).reshape(12, 16)
    assert (grid >= 0).all() and (grid <= 1).all() and grid[5, 15] > 3 * grid[5, 0]


def test_centrality_of_a_chain():
    found = passing.centrality([1, 2, 3], [(1, 2, 1.0), (2, 3, 1.0)])
    assert found[2][0] == 0.5 and found[1][0] == found[3][0] == 0 and found[2][1] > found[1][1]


def test_stability_of_a_man_marker(spark):
    rows = [(0, f, "home", 1, 100, 1.0) for f in range(100)] + [(0, f, "home", 2, 100 + f % 2, 1.0) for f in range(100)]
    found = {r["defender_id"]: r["stability"] for r in marking.stability(spark.createDataFrame(rows, "match_id int, frame int, defending_team string, defender_id int, attacker_id int, dist_m double")).collect()}
    assert found == {1: 1.0, 2: 0.5}


def test_pressure_on_a_static_holder(spark):
    held = spark.createDataFrame([(0, f, 1, "home") for f in range(100)], "match_id int, frame int, holder_id int, team string")
    kin = spark.createDataFrame([(0, f, e, 50.0 if e == 1 else 62 - 6 * f / 25, 30.0, 0.0 if e == 1 else -6.0, 0.0) for f in range(40) for e in (1, 2)], "match_id int, frame int, entity_id int, x double, y double, vx double, vy double")
    teams = spark.createDataFrame([(0, 1, "home"), (0, 2, "away")], "match_id int, entity_id int, team string")
    found = tactics.pressures(kin, held, teams).collect()
    assert len(found) == 1 and found[0]["presser_team"] == "away" and found[0]["target_id"] == 1


def test_projection_and_boxes(spark):
    frame = spark.createDataFrame([(2.0, 3.0, 0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "x double, y double, a double, b double, c double, d double, e double, f double, g double, h double")
    h = [F.lit(v) for v in (2.0, 0.0, 1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 2.0)]
    px, py = pitch.project(h, F.col("x"), F.col("y"))
    none, _ = pitch.project([F.lit(0.0)] * 9, F.col("x"), F.col("y"))
    r = frame.select(px.alias("px"), py.alias("py"), none.alias("none"), pitch.iou(("a", "b", "c", "d"), ("e", "f", "g", "h")).alias("iou")).head()
    assert (r["px"], r["py"], r["none"]) == (2.5, 3.5, None) and np.isclose(r["iou"], 1 / 7)


def test_jumps_go_and_cuts_stay(spark):
    rows = [(0, f, 400.0 if f == 30 else 2.0 * f + (500 if f >= 45 else 0), 100.0, f == 45) for f in range(61)]
    kept = {r["frame"] for r in tracks.without_jumps(spark.createDataFrame(rows, "match_id int, frame int, x double, y double, cut boolean")).collect()}
    assert kept == set(range(61)) - {30}


def test_formats(spark, tmp_path):
    table = lens.tracking(spark, FOLDER).limit(50).withColumns({c: F.lit(None).cast("float") for c in ("x_pixel", "y_pixel")})
    good = formats.coerced(table, formats.TRACKING)
    formats.write_table(good, str(tmp_path), "tracking")
    assert formats.read_table(spark, str(tmp_path), "tracking", formats.TRACKING).count() == 50
    with pytest.raises(formats.MissingData):
        formats.coerced(table.drop("x"), formats.TRACKING)
    wide = tmp_path / "wide.csv"
    wide.write_text(",,,Home,,Home,\n,,,11,,,\nPeriod,Frame,Time [s],Player11,,Ball,\n1,5,0.2,0.5,0.25,NaN,NaN\n1,6,0.24,0.5,0.5,0.1,0.2\n")
    rows = formats.read_wide_csv(spark, str(wide), "away", "m").orderBy("frame", "entity_id").collect()
    assert [(r["frame"], r["entity_id"], round(r["x"], 6), round(r["y"], 6)) for r in rows] == [(0, 111, 52.5, 51.0), (1, -1, 10.5, 54.4), (1, 111, 52.5, 34.0)]
    boxes = tmp_path / "gt.txt"
    boxes.write_text("1,7,10,20,5,6\n")
    assert tuple(formats.read_boxes(spark, str(boxes)).head()) == (0, 7, 10.0, 20.0, 15.0, 26.0, 1.0)


def test_streaming_possession_equals_batch(spark, pass_chain, tmp_path):
    from touchline.streaming.possession import live_possession

    near = possession.nearest_to_ball(pass_chain).select("match_id", "frame", "entity_id", "dist_m").orderBy("frame")
    near.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = live_possession(spark.readStream.schema(near.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("live_held").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    live = {r["frame"]: r["holder_id"] for r in spark.table("live_held").collect()}
    assert live == {r["frame"]: r["holder_id"] for r in possession.possession(pass_chain).collect()}


def test_audit_flags_what_is_no_fact(spark):
    from touchline.operators import report

    known = spark.createDataFrame([(0, "possession.home.share", 0.6467), (0, "events.home.passes", 60.0)], "match_id int, path string, value double")
    text = "Home had 64.7 of the ball and 60 passes in a 4-4-2, not 61.\n## Metrics Appendix\n999"
    found = report.audit(spark.createDataFrame([(0, text), (1, "no numbers")], "match_id int, text string"), known).orderBy("match_id").collect()
    assert [(r["n_claims"], r["n_grounded"], r["grounded_share"]) for r in found] == [(3, 2, 2 / 3), (0, 0, 1.0)]


def test_config_overrides():
    changed = DEFAULT.with_overrides({"possession": {"radius_m": 3.0}, "fps": 50.0})
    assert changed.possession.radius_m == 3.0 and changed.possession.hysteresis_rows == 6 and changed.fps == 50.0
    assert changed.fingerprint() != DEFAULT.fingerprint() and len(DEFAULT.fingerprint()) == 16
    assert DEFAULT.kinematics.window(25) == 13


def plain(value):
    if value is None or value != value:
        return "None"
    return f"{float(value) + 0.0:.5f}" if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("part", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    answer = duck.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in answer.fetchall())
    assert got == want


#: What the tests of the report run.
ELSEWHERE = {"scouting_facts", "match_narrative"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE_SQL) - ELSEWHERE))
def test_query_without_sql_runs(spark, name):
    least = 0 if name == "marking_scores" else 1  # the smallest match has too few samples for its windows
    assert queries.QUERIES[name](spark, FOLDER).count() >= least


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2


def test_hull_in_parts_and_touches(spark):
    from touchline.operators import features

    rng = np.random.default_rng(3)
    points = [(0, e, float(x), float(y)) for e in (1, 2) for x, y in rng.normal(size=(300, 2))] + [(0, 3, float(i), 0.0) for i in range(9)] + [(0, 4, 0.0, 0.0), (0, 4, 1.0, 0.0), (0, 4, 0.0, 1.0)]
    found = {r["entity_id"]: r["hull_area"] for r in features.hull_areas(spark.createDataFrame(points, "match_id int, entity_id int, xa double, ya double").repartition(7)).collect()}
    for e in (1, 2):
        assert found[e] == pytest.approx(hull_area(np.array([p[2:] for p in points if p[1] == e])))
    assert found[3] == 0 and found[4] == 0  # on a line; fewer than four points
    held = spark.createDataFrame([(0, f, h) for f, h in ((0, 5), (1, 5), (5, 5), (6, 6), (8, 5), (9, -1))], "match_id int, frame int, holder_id int")
    assert {tuple(r) for r in features.touches(held).collect()} == {(0, 5, 2, 4), (0, 6, 1, 1)}


def test_questions_meet_synonyms_or_are_refused(spark):
    from touchline.operators import report

    known = spark.createDataFrame([(0, "ppda.home.ppda", 1.25), (0, "physical.away.top_speed", 8.2), (0, "shape.home.out_line", 17.1)], "match_id int, path string, value double")
    asked = [(0, q) for q in ("Who pressed most?", "How fast?", "Will it rain?", "")]
    found = {r["question"]: r for r in report.answers(spark.createDataFrame(asked, "match_id int, question string"), known).collect()}
    assert "`ppda.home.ppda` = 1.250" in found["Who pressed most?"]["answer"]
    assert "physical.away.top_speed" in found["How fast?"]["answer"]
    assert found["Will it rain?"]["answer"] == found[""]["answer"] == report.REFUSAL and found[""]["n_evidence"] == 0


def test_report_is_grounded_in_its_facts(spark):
    from touchline.operators import report

    facts = [(0, "possession.home.share", 0.4833), (0, "possession.home.n_spells", 18.0), (0, "physical.home.distance_m", 2999.82), (0, "physical.home.sprints", 0.0)]
    known = spark.createDataFrame(facts, "match_id int, path string, value double")
    texts = report.written(known)
    text = texts.first()["text"]
    assert "48% of the ball, in 18 spells" in text and "ran 3000 m" in text and "away" not in text
    assert report.audit(texts, known).first()["grounded_share"] == 1.0


def test_events_look_ahead_in_one_pass(spark):
    rows = spark.createDataFrame([(1, f, -1, "ball", "none", float(f), 1.0) for f in (2, 5)] + [(1, f, 3, "player", "home", 1.0, 1.0) for f in range(8)], "match_id int, frame int, entity_id int, class string, team string, x double, y double")
    found = play.nearest_ball(rows)
    assert [(r.frame, r.ball_frame) for r in found.orderBy("frame").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 5), (5, 5), (6, 5), (7, 5)]
    # a frame that ends with its partition is summed anew for each row
    plan = play.events(rows, possession.possession(rows))._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan


def test_clipped_areas_of_many_frames_match_one_by_one():
    rng = np.random.default_rng(7)
    points = rng.uniform((-5, -5), (110, 73), (60, 22, 2))
    points[0, 3] = points[0, 9]  # two in one place
    points[1, 5:] = np.nan  # few seen
    points[2, :, 0] = 50.0  # in a row
    points[3] = np.round(points[3] / 10) * 10
    found = control.clipped_areas(points, 105.0, 68.0)
    for frame, areas in zip(points, found):
        seen = frame[np.isfinite(frame).all(axis=1)]
        assert np.allclose(areas[: len(seen)], [control.clipped_area(seen, i, 105.0, 68.0) for i in range(len(seen))], atol=1e-9)
        assert not areas[len(seen) :].any()
    assert control.clipped_areas(np.zeros((0, 4, 2)), 105.0, 68.0).shape == (0, 4)


def test_tangents_equal_their_sql_to_the_last_bit(spark, duck):
    rows = queries.circle_tangents(spark, FOLDER).orderBy("match_id", "frame").collect()
    assert [tuple(r) for r in rows] == duck.execute(f"{oracle._SQL['circle_tangents']} ORDER BY match_id, frame").fetchall()
    centre = spark.createDataFrame([(0.0, 0.0, 5.0)], "p double, q double, r double")
    (x1, y1), _ = conics.meets(conics.circle(F.lit(52.5), F.lit(34.0), F.lit(9.15)), (F.col("p"), F.col("q"), F.col("r")))
    assert tuple(centre.select(x1, y1).head()) == (None, None)


def test_shape_means_round_halves_up_in_any_order(spark):
    # the mean is 25.35, but sums of doubles fall short of it or not by their order
    values = next(v for v in itertools.product([x / 100 for x in range(2520, 2550)], repeat=3) if round(sum(v) * 100) == 7605 and sum(v) / 3 < 25.35)
    rows = [(1, f, "home", v, v, v, 30.0, own) for f, v in enumerate(values) for own in (True, False)]
    shapes = spark.createDataFrame(rows, "match_id int, frame int, team string, def_line_height_m double, depth_m double, width_m double, centroid_x_att double, in_possession boolean").coalesce(1)
    found = tactics.shape_summary(shapes).head()
    assert {found[c] for c in ("in_line", "out_line", "in_depth", "out_depth", "in_width", "out_width")} == {25.4}


def test_pressures_compute_the_motion_once(spark):
    seen = lens.tracking(spark, FOLDER)
    teams = possession.players_only(seen).groupBy("match_id", "entity_id").agg(F.min("team").alias("team"))
    held = spark.createDataFrame([(0, 5, 3, "home")], "match_id int, frame int, holder_id int, team string")
    plan = tactics.pressures(movement.kinematics(seen), held, teams)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") == 1


def test_motion_of_runs_gaps_and_short_runs(spark):
    """Runs are numbered over all, short ones included, but left out; observations in any order; filled rows don't make a run longer."""
    rng = np.random.default_rng(3)
    frames = [*range(5), *range(20, 60), 62, 65, *range(66, 80), *range(100, 136, 3)]
    rows = [row(f, 1, "home", *rng.uniform(10, 60, 2)) for f in frames]
    found = movement.kinematics(spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], SCHEMA)).orderBy("frame").collect()
    assert [r["frame"] for r in found] == list(range(20, 80)) and {r["run"] for r in found} == {2}
    known = {r[1]: r[7] for r in rows}
    x = np.interp(np.arange(20, 80), sorted(f for f in known), [known[f] for f in sorted(known)])
    want = [np.polyval(np.polyfit(np.arange(13), x[c - 6 : c + 7], 2), i - c + 6) for i in range(60) for c in [min(max(i, 6), 53)]]
    assert np.allclose([r["x"] for r in found], want) and np.allclose([r["vx"] for r in found], np.gradient(want) * 25)
    speeds = [r["speed"] for r in found]
    assert None in speeds and all(v is None or v <= 11 for v in speeds)
    assert np.allclose([r["accel"] for r in found], np.gradient([v or 0.0 for v in speeds]) * 25)
    assert movement.kinematics(spark.createDataFrame(rows[:5], SCHEMA)).count() == 0


def test_many_assignments_equal_one_by_one():
    from touchline.functions.assignment import assign_many

    rng = np.random.default_rng(5)
    for n, m in ((10, 10), (5, 8), (9, 6), (1, 1)):
        cost = np.concatenate([rng.uniform(0, 9, (20, n, m)), rng.integers(0, 3, (20, n, m)).astype(float)])
        for own, cols in zip(cost, assign_many(cost)):
            rows, want = assign(own)
            assert [(r, c) for r, c in enumerate(cols.tolist()) if c >= 0] == list(zip(rows.tolist(), want.tolist()))
    assert assign_many(np.zeros((0, 3, 3))).shape == (0, 3)


def test_defenders_of_uneven_teams_are_assigned_frame_by_frame(spark):
    from touchline.operators.marking import MAX_PAIR_M

    rng = np.random.default_rng(6)
    rows = [row(f, e, "home" if e < 20 else "away", *rng.uniform(20, 50, 2)) for f in range(0, 200, 25) for e in (*range(5 + f // 25 % 3), *range(20, 25 + f // 25 % 2))]
    phases = spark.createDataFrame([(0, f, "away", "progression") for f in range(200)], "match_id int, frame int, poss_team string, phase string")
    found = {(r["frame"], r["defender_id"], r["attacker_id"], r["dist_m"]) for r in marking.assignments(spark.createDataFrame(rows, SCHEMA), phases).collect()}
    want = set()
    for f in range(0, 200, 25):
        own, other = ([r for r in rows if r[1] == f and (r[3] < 20) == home] for home in (True, False))
        cost = np.array([[np.hypot(a[7] - b[7], a[8] - b[8]) for b in other] for a in own])
        want |= {(f, own[r][3], other[c][3], round(float(cost[r, c]), 2)) for r, c in zip(*assign(np.where(cost > MAX_PAIR_M, cost + 1e5, cost))) if cost[r, c] <= MAX_PAIR_M}
    assert found == want


def test_modal_values_ignore_nulls_and_take_the_least_on_ties(spark):
    rows = [(0, f, f / 25, 1, "player", team, number, 1.0, 1.0, 1.0) for f, (team, number) in enumerate([("home", None), ("away", 7), ("away", None), ("home", 3), ("home", None)])]
    assert [tuple(r) for r in possession.modal(spark.createDataFrame(rows, SCHEMA), "team", "jersey_no").select("team", "jersey_no").collect()] == [("home", 3)]


@pytest.mark.parametrize("name,sorts", [("formation_places", 0), ("marking_pairs", 1)])
def test_players_of_a_frame_meet_it_unsorted(spark, name, sorts):
    """Rows of all players were sorted by frame for joins, and by player for the most frequent values; only the motion needs an order."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "mode(" not in plan and "count(distinct" not in plan and plan.count("strategy=shuffle_hash") >= 1
        assert plan.count("Generate explode(sequence") == sorts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_postures_at_a_bound_do_not_depend_on_the_order_of_rows(spark):
    """The away players' mean is 34 added by id and a little less from the last to the first, in which order the rows come."""
    places = [28.6, 44.0, 28.7, 46.3, 22.4]
    rows = [row(f, e, t, x, 30) for f in range(2) for e, t, x in ((-1, "none", 50), (1, "home", 50), *((20 - i, "away", x) for i, x in enumerate(reversed(places), 1)))]
    held = spark.createDataFrame([(0, f, 1, "home", 0.0) for f in range(2)], "match_id int, frame int, holder_id int, team string, dist_m double")
    matches = spark.createDataFrame([(0, -1, 3000)], "match_id int, home_sign int, halftime_frame int")
    for found in (rows, rows[::-1]):
        seen = spark.createDataFrame(found, SCHEMA).coalesce(1)
        assert {r["def_posture"] for r in tactics.phases(seen, held, matches).collect()} == {"mid_block"}
