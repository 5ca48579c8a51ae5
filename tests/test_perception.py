"""Tracks, balls, homographies and their measures: scenes with known answers, loops and enumeration by hand, tables against streams."""

import itertools
import random

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from touchline.config import DEFAULT
from touchline.functions import conics, homography
from touchline.functions.assignment import assign, matched, overlaps
from touchline.operators import calibration, evaluation, tracker
from touchline.sources import camera
from touchline.streaming.live import live

FOLDER = "/root/testdata/sf0.001"
BOX = "match_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, class string"


def det(match, frame, x, y, conf=0.9, kind="player"):
    return (match, frame, float(x), float(y), x + 20.0, y + 40.0, conf, kind)


def nothing(match, frame):
    return (match, frame, None, None, None, None, None, None)


def by_frame(df, match="m1"):
    found = {}
    for r in df.where(F.col("match_id") == match).collect():
        found.setdefault(r["frame"], []).append(r["track_id"])
    return found


def test_matched_takes_the_cheapest_pairs_of_each_part():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = np.array([[rng.choice((0.1, 0.4, 0.7, 2.0)) + rng.random() / 100 for _ in range(m)] for _ in range(n)])
        gated = np.where(cost > 1, 1 + 1e5, cost)
        rows, cols = assign(gated)
        assert matched(cost, 1.0) == sorted((int(r), int(c)) for r, c in zip(rows, cols) if cost[r, c] <= 1)
    assert matched(np.ones((2, 2)), 1.0, strict=True) == [] and matched(np.zeros((0, 3)), 1.0) == []


def test_ids_persist_through_motion_occlusion_and_low_scores(spark):
    rows = []
    for f in range(40):
        rows += [det("m1", f, 100 + 3 * f, 100), det("m1", f, 400 - 3 * f, 200)]
        rows.append(nothing("m2", f) if 15 <= f < 25 else det("m2", f, 100 + 4 * f, 150))
        rows.append(det("m3", f, 100 + 3 * f, 150, 0.9 if f < 10 or f > 20 else 0.25))
    found = tracker.tracks(spark.createDataFrame(rows, BOX)).cache()
    one = by_frame(found)
    assert all(sorted(ids) == [1, 2] for ids in one.values()) and len(one) == 40
    two = by_frame(found, "m2")
    assert set(two) == set(range(15)) | set(range(25, 40)) and {i for ids in two.values() for i in ids} == {1}
    assert by_frame(found, "m3") == {f: [1] for f in range(40)}


def test_births_need_two_hits_and_lost_tracks_end(spark):
    rows = [nothing("m1", 0), det("m1", 1, 0, 0), nothing("m1", 2), det("m1", 3, 0, 0), det("m1", 4, 0, 0), *(nothing("m1", f) for f in range(5, 45)), det("m1", 45, 0, 0), det("m1", 46, 0, 0), det("m1", 47, 0, 0, 0.55), det("m1", 47, 500, 0, 0.55)]
    assert by_frame(tracker.tracks(spark.createDataFrame(rows, BOX))) == {4: [1], 46: [2], 47: [2]}


def test_classes_are_voted_and_balls_are_left_out(spark):
    rows = [det("m1", f, 10, 10, 0.9, "goalkeeper" if f % 3 == 0 else "player") for f in range(9)] + [det("m1", f, 300, 10, 0.9, "ball") for f in range(9)]
    kinds = {r["frame"]: r["class"] for r in tracker.tracks(spark.createDataFrame(rows, BOX)).collect()}
    assert kinds[0] == "goalkeeper" and kinds[8] == "player" and len(kinds) == 9


def test_speed_gate_and_identities_across_a_cut(spark):
    flat = [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0]  # ten pixels a metre: 12.5 m/s are 5 pixels a frame
    looks = {"a": [1.0, 0.0, 0.2], "b": [0.0, 1.0, 0.2]}
    rows = []
    for f in range(30):
        shift = 0 if f < 15 else 30
        for who, x in (("a", 100), ("b", 400)):
            jump = 8 if f == 10 and who == "a" else 0
            rows.append((*det("m1", f, x + shift + jump, 100), flat, f == 15, looks[who]))
    schema = BOX + ", homography array<double>, cut boolean, feature array<double>"
    found = tracker.tracks(spark.createDataFrame(rows, schema))
    ids = by_frame(found)
    assert sorted(ids[0]) == [1, 2] and len(ids[10]) == 1  # an impossible step is no step
    assert 15 not in ids and sorted(ids[17]) == [1, 2]  # known again by their looks after the cut
    without = tracker.tracks(spark.createDataFrame([(*r[:8], None, r[9], None) for r in rows], schema))
    assert len(by_frame(without)[10]) == 2 and sorted(by_frame(without)[17]) == [3, 4]


def loop_ball(frames):
    """The ball's filter written out for one axis at a time, as both axes never mix."""
    kept, x, p, missed = {}, None, None, 0
    move = np.array([[1.0, 1.0], [0.0, 1.0]])
    for f in sorted(frames):
        if x is not None:
            x, p = [move @ v for v in x], [move @ v @ move.T + np.diag([2.0, 4.0]) for v in p]
        found = [c for c in frames[f] if c[0] is not None]
        if x is None:
            best = max(found, key=lambda c: c[2], default=None)
        else:
            near = [c for c in found if np.hypot(c[0] - x[0][0], c[1] - x[1][0]) <= 120 * (1 + 0.5 * missed)]
            best = min(near, key=lambda c: np.hypot(c[0] - x[0][0], c[1] - x[1][0]) - 50 * c[2], default=None)
        if best is None:
            missed += 1
            if missed > 25:
                x = None
            continue
        missed, kept[f] = 0, best
        if x is None:
            x, p = [np.array([v, 0.0]) for v in best[:2]], [np.eye(2) * 50.0] * 2
        else:
            gain = [v[:, :1] / (v[0, 0] + 4.0) for v in p]
            x = [v + g[:, 0] * (z - v[0]) for v, g, z in zip(x, gain, best)]
            p = [v - g @ v[:1] for v, g in zip(p, gain)]
    return kept


def test_ball_of_the_derived_matches_equals_a_loop(spark):
    rows = camera.ball_candidates(spark, FOLDER).orderBy("match_id", "frame").collect()
    frames = {}
    for r in rows:
        frames.setdefault((r["match_id"], r["frame"]), []).append((r["x"], r["y"], r["conf"]))
    got = {(r["match_id"], r["frame"]): (r["x"], r["y"], r["conf"]) for r in tracker.ball_track(camera.ball_candidates(spark, FOLDER)).collect()}
    want = {}
    for match in {m for m, _ in frames}:
        want |= {(match, f): c for f, c in loop_ball({f: v for (m, f), v in frames.items() if m == match}).items()}
    assert got == want and 0 < len(got) < len(frames)


def test_planted_homographies_are_recovered_and_degenerate_sets_refused(spark):
    rng = np.random.default_rng(2)
    for n in (4, 5, 12):
        h = np.array([[0.08, 0.01, -3], [0.002, 0.11, -2], [0.0001, 0.0004, 1]]) * (1 + rng.random((3, 3)) / 50)
        source = rng.uniform(0, 1000, (20, n, 2))
        target = homography.apply(np.broadcast_to(h, (20, 3, 3)), source)
        got, sound = homography.fit(source, target)
        assert sound.all() and np.allclose(got, h / h[2, 2], rtol=1e-6, atol=1e-8) and (homography.rms(got, source, target) < 1e-6).all()
    line = np.stack([np.arange(4.0), 2 * np.arange(4.0)], axis=1)[None]
    for bad in (line, np.ones((1, 4, 2)), np.zeros((1, 3, 2))):
        got, sound = homography.fit(bad, bad)
        assert not sound.any() and np.isnan(got).all()
    found = calibration.fitted_homographies(camera.correspondences(spark, FOLDER)).collect()
    assert {r["sound"] for r in found if r["frame"] % 50 == 0} == {False} and all(r["rms_m"] < 0.3 for r in found if r["sound"] and r["n_points"] == 6)
    assert sum(r["sound"] for r in found) > 50
    flat = lambda h: spark.createDataFrame([(np.asarray(h, float).ravel().tolist(),)], "h array<double>").select(homography.plausible([F.get("h", F.lit(i)) for i in range(9)], 1280, 720).alias("p")).head()["p"]
    assert flat(camera.TO_PITCH) and not flat(camera.TO_PITCH * [[1], [-1e-4], [1]]) and not flat(np.zeros((3, 3)))
    assert not flat([[0.08, 0, 0], [0, 0.08, 0], [0, -0.002, 1]])  # the horizon crosses the image


def test_steady_homographies_keep_the_true_one(spark):
    found = tracker.steady_homographies(camera.homography_estimates(spark, FOLDER)).collect()
    points = np.array([[200.0, 100.0], [900.0, 150.0], [1000.0, 500.0], [300.0, 480.0]])
    far = [np.abs(homography.apply(np.array(r["homography"]).reshape(3, 3), points) - homography.apply(camera.TO_PITCH, points)).max() for r in found]
    assert len(found) == spark.read.parquet(f"{FOLDER}/orders.parquet").count() and np.median(far) < 0.3 and max(far) < 1.0


def test_smoother_blends_snaps_after_a_cut_and_leaves_jumps_out(spark):
    def at(jx):
        h = camera.TO_PITCH.copy()
        h[0] += jx * h[2]
        return h.ravel().tolist()

    rows = [("m1", 0, at(0.0), False, None), ("m1", 1, at(2.0), False, None), ("m1", 2, at(90.0), False, None), ("m1", 3, at(4.0), True, None), ("m1", 4, None, False, [1.0, 0.0, 12.0, 0.0, 1.0, 0.0]), ("m2", 0, None, False, None), ("m2", 1, at(1.0), False, None)]
    found = {(r["match_id"], r["frame"]): np.array(r["homography"]).reshape(3, 3) for r in tracker.steady_homographies(spark.createDataFrame(rows, "match_id string, frame int, homography array<double>, cut boolean, shift array<double>")).collect()}
    place = lambda key: homography.apply(found[key], np.array([[400.0, 300.0]]))[0, 0] - homography.apply(camera.TO_PITCH, np.array([[400.0, 300.0]]))[0, 0]
    assert set(found) == {("m1", 0), ("m1", 1), ("m1", 2), ("m1", 3), ("m1", 4), ("m2", 1)}
    assert abs(place(("m1", 1)) - 1.0) < 0.1 and place(("m1", 2)) == place(("m1", 1)) and abs(place(("m1", 3)) - 4.0) < 1e-6 and place(("m1", 4)) < place(("m1", 3)) - 0.5


def enumerated(truth, found, least):
    """Frame by frame over all one-to-one maps, then over all maps of ids."""
    last, pairs = {}, []
    for f in sorted({r[0] for r in truth} | {r[0] for r in found}):
        a, b = [r for r in truth if r[0] == f], [r for r in found if r[0] == f]
        if not a or not b:
            continue
        iou = overlaps(np.array([r[2:] for r in a]), np.array([r[2:] for r in b]))
        gain = iou + np.array([[0.2 if last.get(x[1]) == y[1] and iou[i, j] >= least else 0 for j, y in enumerate(b)] for i, x in enumerate(a)])
        k = min(len(a), len(b))
        best = max(((sum(gain[i, j] for i, j in zip(rows, cols)), list(zip(rows, cols))) for rows in itertools.combinations(range(len(a)), k) for cols in itertools.permutations(range(len(b)), k)), key=lambda t: t[0])[1]
        for i, j in best:
            if iou[i, j] >= least:
                pairs.append((a[i][1], b[j][1], last.get(a[i][1], b[j][1]) != b[j][1]))
                last[a[i][1]] = b[j][1]
    ids, to = sorted({r[1] for r in truth}), sorted({r[1] for r in found})
    n = {(x, y): sum(p[:2] == (x, y) for p in pairs) for x in ids for y in to}
    k = min(len(ids), len(to))
    same = max((sum(n[x, y] for x, y in zip(xs, ys)) for xs in itertools.combinations(ids, k) for ys in itertools.permutations(to, k)), default=0)
    switches, lost, false = sum(p[2] for p in pairs), len(truth) - len(pairs), len(found) - len(pairs)
    return round(1 - (lost + false + switches) / max(len(truth), 1), 4), round(2 * same / max(len(truth) + len(found), 1), 4), switches, false, lost, len(pairs), len(truth), len(found)


def test_tracking_metrics_against_enumeration(spark):
    rng = random.Random(6)
    rows, wanted = ([], []), {}
    for m in range(5):
        truth, found = [], []
        for f in range(25):
            for e in range(4):
                x, y = 10 * e + rng.uniform(0, 12), rng.uniform(0, 6)
                truth.append((f, e, x, y, x + 20, y + 20))
                who = 10 + ((e + 1) % 4 if f >= 12 and m % 2 else e)  # ids swap at half
                if rng.random() > 0.15:
                    dx, dy = rng.uniform(-9, 9), rng.uniform(-4, 4)
                    found.append((f, who, x + dx, y + dy, x + dx + 20, y + dy + 20))
            if rng.random() < 0.2:
                found.append((f, 99, 300.0, 0.0, 320.0, 20.0))
        wanted[f"m{m}"] = enumerated(truth, found, 0.5)
        for part, source in zip(rows, (truth, found)):
            part += [(f"m{m}", *r) for r in source]
    wanted["lone"] = (0.0, 0.0, 0, 0, 1, 0, 1, 0)
    rows[0].append(("lone", 3, 1, 0.0, 0.0, 9.0, 9.0))
    truth, found = (spark.createDataFrame(r, "match_id string, frame int, track_id int, x1 double, y1 double, x2 double, y2 double") for r in rows)
    got = {r["match_id"]: tuple(r)[1:] for r in evaluation.tracking_metrics(truth, found).collect()}
    assert got == wanted and any(w[2] > 2 for w in wanted.values())
    same = evaluation.tracking_metrics(truth, truth).where("match_id = 'm1'").head()
    assert (same["mota"], same["idf1"], same["id_switches"]) == (1.0, 1.0, 0)


def test_events_match_one_to_one_like_a_loop(spark):
    rng = random.Random(7)
    derived = [(m, rng.randrange(600)) for m in ("m1", "m2") for _ in range(60)] + [("m3", 5)]
    truth = [(m, rng.randrange(600)) for m in ("m1", "m2") for _ in range(45)] + [("m4", 5)]
    number = lambda rows: [(m, f, i) for i, (m, f) in enumerate(sorted(rows))]
    derived, truth = number(derived), number(truth)
    used, wanted = set(), []
    for m, f, n in derived:
        first = next((t for t in truth if t[0] == m and abs(t[1] - f) < 40 and t not in used), None)
        if first:
            used.add(first)
            wanted.append((m, f, n, first[1], first[2]))
    frames = [spark.createDataFrame(rows, "match_id string, frame int, n int") for rows in (derived, truth)]
    assert sorted(map(tuple, evaluation.matched_events(*frames).collect())) == sorted(wanted)
    got = {r["match_id"]: r for r in evaluation.event_agreement(*frames).collect()}
    assert got["m3"]["precision"] == 0 and got["m4"]["recall"] == 0 and got["m1"]["n_matched"] == sum(w[0] == "m1" for w in wanted)


@pytest.mark.parametrize("what", ["tracks", "ball", "camera"])
def test_streams_give_what_tables_give(spark, tmp_path, what):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the stream waits for its timers
    tables = {"tracks": camera.detections, "ball": camera.ball_candidates, "camera": camera.homography_estimates}
    steps = {"tracks": (tracker.Tracks, tracker.track_step(), tracker.track_schema("int")), "ball": (tracker.Ball, tracker.ball_step(), tracker.ball_schema("int")), "camera": (tracker.Camera, tracker.camera_step(), tracker.camera_schema("int"))}
    table = tables[what](spark, FOLDER).where("frame < 70").orderBy("frame").cache()
    for k, (a, b) in enumerate(((0, 40), (40, 41), (41, 70))):  # three micro-batches, in the order of their files
        table.where((F.col("frame") >= a) & (F.col("frame") < b)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    running = live(stream, *steps[what], 60_000).writeStream.format("memory").queryName(f"live_{what}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(240)
    batch = {"tracks": tracker.tracks, "ball": tracker.ball_track, "camera": tracker.steady_homographies}[what](table)
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(spark.table(f"live_{what}")) == plain(batch) and batch.count() > 20


def test_conics(spark):
    row = spark.createDataFrame([(3.0, 4.0, 5.0, 13.0, 4.0)], "cx double, cy double, r double, px double, py double")
    c = conics.circle(F.col("cx"), F.col("cy"), F.col("r"))
    line = conics.polar(c, F.col("px"), F.col("py"))
    back, ends = conics.pole(c, line), conics.meets(c, line)
    secant = conics.meets(c, (F.lit(0.0), F.lit(1.0), -F.col("cy")))
    none = conics.meets(c, (F.lit(1.0), F.lit(0.0), F.lit(-100.0)))
    cross = conics.crossing((F.lit(1.0), F.lit(0.0), F.lit(-2.0)), (F.lit(0.0), F.lit(1.0), F.lit(-7.0)))
    got = row.select(*back, *ends[0], *ends[1], *secant[0], *secant[1], none[0][0], *cross).head()
    assert np.allclose(got[:2], (13, 4)) and np.allclose(sorted([got[2:4], got[4:6]]), [(5.5, 4 - 18.75**0.5), (5.5, 4 + 18.75**0.5)])
    assert sorted([tuple(got[6:8]), tuple(got[8:10])]) == [(-2.0, 4.0), (8.0, 4.0)] and got[10] is None and tuple(got[11:13]) == (2.0, 7.0)


def test_foot_boxes_and_scene_cuts(spark):
    boxes = evaluation.foot_boxes(spark.createDataFrame([("m1", 0, 3, 50.0, 60.0), ("m1", 1, 3, None, 1.0)], "match_id string, frame int, entity_id int, x_pixel double, y_pixel double")).collect()
    assert [tuple(r)[2:] for r in boxes] == [(3, 44.0, 36.0, 56.0, 60.0)]
    rows = [("m1", f, [1.0, 0.0, 9.0] if f < 5 else [9.0, 0.0, 1.0]) for f in range(9)] + [("m2", 0, [0.0, 1.0, 0.0])]
    cuts = {(r["match_id"], r["frame"]) for r in tracker.scene_cuts(spark.createDataFrame(rows, "match_id string, frame int, histogram array<double>")).where("cut").collect()}
    assert cuts == {("m1", 5)} and DEFAULT.tracking.limit == 0.8


def test_folds_use_all_tasks_and_the_camera_many_frames_at_once(spark):
    """Small rows are not dealt to a few tasks; what ready and finish do for many frames is what a step does for one."""
    from touchline.functions.folds import fold
    from touchline.sources.camera import TO_PITCH

    def where(state, match, frame, rows):
        return [(match, TaskContext.get().partitionId())]

    few = spark.createDataFrame([(m, f) for m in range(40) for f in range(3)], "match_id int, frame int")
    assert len({r["task"] for r in fold(few, dict, where, "match_id int, task int").collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rng, rows = np.random.default_rng(3), []
    for f in range(60):
        h = TO_PITCH + np.outer([f % 7 / 20, 0, 0], TO_PITCH[2]) + rng.normal(0, 1e-6, (3, 3))
        flat = None if f % 5 == 3 else [0.0] * 9 if f in (0, 12) else h.ravel().tolist()
        rows.append({"homography": flat, "cut": f == 31, "shift": [1.0, 0.0, 0.5, 0.0, 1.0, 0.0] if flat is None else None})
    one, many = tracker.Camera(), tracker.Camera()
    alone = [r for f, row in enumerate(rows) for r in tracker.camera_step()(one, 0, f, [dict(row)])]
    tracker.camera_ready()(rows)
    step = tracker.camera_step(fitted=False)
    together = tracker.camera_finish()([r for f, row in enumerate(rows) for r in step(many, 0, f, [row])])
    assert [r[:2] for r in alone] == [r[:2] for r in together] and len(alone) == 59
    assert np.allclose([r[2] for r in alone], [r[2] for r in together], rtol=1e-12)


def test_frames_of_many_matches_are_one_step(spark):
    """Tracks of several matches at once are those of each match alone: crossings, losses, cuts, frames without boxes or of some matches only, missing classes."""
    rng, rows = np.random.default_rng(3), []
    to_pitch = [float(v) for v in camera.TO_PITCH.ravel()]
    at, by = rng.uniform([100, 60], [1200, 600], (4, 22, 2)), rng.normal(0, 3, (4, 22, 2))
    for f in range(90):
        at = at + by
        for m in range(4):
            if (f * 7 + m) % 23 == 0:
                rows += [(f"m{m}", f, *[None] * 6, None, False)] if m % 2 else []
                continue
            for e in np.flatnonzero(rng.random(22) > 0.08).tolist():
                (x, y), h, (dx, dy) = at[m, e], 30 + at[m, e, 1] / 12, rng.normal(0, 1, 2)
                kind = ["player", "player", "goalkeeper", "ball", None][rng.integers(5)]
                rows.append((f"m{m}", f, x - h / 5 + dx, y - h + dy, x + h / 5 + dx, y + dy, float(rng.choice([0.2, 0.55, 0.7, 0.9])), kind, to_pitch if m != 2 else None, f == 37 and m == 1))
    rows = [tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows]
    names = ["match_id", "frame", "x1", "y1", "x2", "y2", "conf", "class", "homography", "cut"]
    step, want = tracker.track_step(), []
    for m in range(4):
        state = tracker.Tracks()
        for f in range(90):
            found = [dict(zip(names, r)) for r in rows if r[:2] == (f"m{m}", f)]
            want += step(state, f"m{m}", f, found) if found else []
    schema = "match_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, class string, homography array<double>, cut boolean"
    table = tracker.tracks(spark.createDataFrame(rows, schema).coalesce(1))
    order = lambda r: tuple(str(v) for v in r)
    assert len(want) > 3000 and sorted(map(tuple, table.collect()), key=order) == sorted(want, key=order)
    assert tracker.tracks(spark.createDataFrame([], schema)).count() == 0


def test_boxes_of_many_matches_are_matched_in_one_step(spark):
    """Pairs of several matches at once are those of each match alone: near boxes, changed ids, ids that a frame has twice."""
    rng, rows = np.random.default_rng(4), []
    at, by = rng.uniform([100, 60], [500, 300], (3, 12, 2)), rng.normal(0, 4, (3, 12, 2))
    for f in range(40):
        at = at + by
        for m in range(3):
            for e in range(12):
                (x, y), h, d = at[m, e], 30 + at[m, e, 1] / 12, rng.normal(0, 2, 2)
                rows.append((f"m{m}", f, 0 if e == 11 else e, *(float(v) for v in (x - h / 5, y - h, x + h / 5, y)), True))
                if rng.random() < 0.9:
                    rows.append((f"m{m}", f, 0 if e == 10 else e + 100 * (f // 15 * (e % 3 == 0)), *(float(v) for v in (x - h / 5 + d[0], y - h + d[1], x + h / 5 + d[0], y + d[1])), False))
    names, want = ["match_id", "frame", "track_id", "x1", "y1", "x2", "y2", "true"], []
    step = evaluation.match_step(0.5)
    for m in range(3):
        last = {}
        for f in range(40):
            want += step(last, f"m{m}", f, [dict(zip(names, r)) for r in rows if r[:2] == (f"m{m}", f)])
    table = spark.createDataFrame(rows, "match_id string, frame int, track_id int, x1 double, y1 double, x2 double, y2 double, true boolean").coalesce(1)
    pairs = evaluation.matched_boxes(table.where(F.col("true")), table.where(~F.col("true")))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and any(r[4] for r in want)
    assert "Sort [frame" in plan
