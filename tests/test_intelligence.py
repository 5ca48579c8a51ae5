"""Style vectors, roles and teams against NumPy and enumeration, and every operator on a table with string ids."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import clusters
from touchline.operators import control, embedding, evaluation, features, formations, marking, movement, passing, play, possession, report, style, tactics, teams, tracks
from touchline.sources import lens

FOLDER = "/root/testdata/sf0.001"


def test_kmeans_and_silhouette_against_enumeration():
    rng = np.random.default_rng(1)
    for k in (2, 3):
        x = np.concatenate([rng.normal(5 * c, 1.0, (3, 2)) for c in range(k)])
        own, centres = clusters.kmeans(x, k)
        cost = lambda o: sum(((x[np.array(o) == c] - x[np.array(o) == c].mean(axis=0)) ** 2).sum() for c in set(o))
        assert np.isclose(cost(own.tolist()), min(cost(o) for o in itertools.product(range(k), repeat=len(x)) if len(set(o)) == k))
        assert own[0] == 0 and np.allclose(centres[own[0]], x[own == own[0]].mean(axis=0))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        each = []
        for i in range(len(x)):
            a = d[i][(own == own[i]) & (np.arange(len(x)) != i)].mean()
            b = min(d[i][own == c].mean() for c in set(own.tolist()) - {own[i]})
            each.append((b - a) / max(a, b))
        assert np.isclose(clusters.silhouette(x, own), np.mean(each))
    assert clusters.silhouette(np.array([[0.0], [0.1], [9.0]]), np.array([0, 0, 1])) < 1  # a lone row counts as 0


def archetypes(spark, match="m1"):
    """Twelve players of three kinds in the features and on the map."""
    rng = np.random.default_rng(4)
    rows, cells = [], []
    for e in range(12):
        kind = e % 3
        values = {n: float(10 * ((i * 7 + kind * 5) % 11) + rng.normal(0, 1.0)) for i, n in enumerate(embedding.NAMES)}
        rows.append((match, e, "home", 90.0, *(values[n] for n in embedding.NAMES)))
        cells += [(match, e, 3 + 4 * kind, 4 + 6 * kind + j, 0.25) for j in range(4)]
    schema = "match_id string, entity_id int, team string, minutes double, " + ", ".join(f"{n} double" for n in embedding.NAMES)
    return spark.createDataFrame(rows, schema), spark.createDataFrame(cells, "match_id string, entity_id int, iy int, ix int, v double")


def test_style_vectors_part_archetypes_and_equal_numpy(spark):
    found, maps = archetypes(spark)
    rows = embedding.style_rows(found, maps)
    table = {r["entity_id"]: np.array(r["x"]) for r in rows.collect()}
    x = np.stack([table[e] for e in range(12)])
    assert x.shape == (12, len(embedding.NAMES) + 16 * 24)
    assert np.allclose(np.linalg.norm(x[:, len(embedding.NAMES) :], axis=1), 0.6 * len(embedding.NAMES) ** 0.5)
    assert np.allclose(sorted({round(float(v), 6) for v in x[0, len(embedding.NAMES) :]}), [0, round(0.3 * len(embedding.NAMES) ** 0.5, 6)])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    flip = np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)] < 0, -1, 1)
    wanted = (u * s * flip)[:, :11]
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    for vectors in (embedding.match_vectors(rows), embedding.all_vectors(rows.repartition(5))):
        got = {r["entity_id"]: np.array(r["vector"]) for r in vectors.collect()}
        v = np.stack([got[e] for e in range(12)])
        assert np.allclose(np.linalg.norm(v, axis=1), 1) and np.allclose(v[:, :11], wanted, atol=1e-6)
        near = v @ v.T
        same = np.equal.outer(np.arange(12) % 3, np.arange(12) % 3)
        assert near[same].min() > near[~same].max() + 0.3
    own = {r["entity_id"]: r["cluster"] for r in embedding.style_clusters(embedding.match_vectors(rows), k=3).collect()}
    assert all((own[a] == own[b]) == (a % 3 == b % 3) for a in range(12) for b in range(12))
    chosen = embedding.style_clusters(embedding.match_vectors(rows)).collect()
    assert all(4 <= r["k"] <= 9 for r in chosen) and all(len({e % 3 for r in chosen for e in [r["entity_id"]] if r["cluster"] == c}) == 1 for c in {r["cluster"] for r in chosen})
    few = rows.where("entity_id < 5")
    assert embedding.style_clusters(embedding.match_vectors(few)).count() == 0 and len(embedding.match_vectors(few).head()["vector"]) == x.shape[1]
    assert embedding.all_vectors(rows.where("false")).count() == 0


@pytest.mark.parametrize(
    "depth,wide,touches,press,dist,between,reach,push,role",
    [
        (20, 5, 2.0, 0, 90, 0.0, 20, 0, "ball-playing centre-back"), (20, 5, 0.5, 0, 90, 0.06, 20, 0, "ball-playing centre-back"), (20, 5, 0.5, 0, 90, 0.0, 20, 0, "no-nonsense centre-back"),
        (20, 20, 0, 0, 90, 0, 20, 9.5, "attacking fullback"), (20, 20, 0, 0, 90, 0, 33, 0, "attacking fullback"), (31.9, 13, 0, 0, 90, 0, 20, 9, "defensive fullback"),
        (40, 5, 2, 1, 90, 0, 20, 0, "deep-lying playmaker"), (32, 5, 1, 1, 90, 0, 20, 0, "ball-winning midfielder"), (45, 5, 2, 0, 106, 0, 20, 0, "box-to-box midfielder"),
        (45, 5, 2, 0, 90, 0, 20, 0, "advanced playmaker"), (45, 5, 1, 0, 90, 0, 20, 0, "box-to-box midfielder"), (45, 15, 2, 1, 110, 0, 20, 0, "wide midfielder"),
        (52, 15, 0, 0, 90, 0, 20, 0, "winger"), (60, 5, 0, 1, 110, 0, 20, 0, "pressing forward"), (60, 5, 0, 0, 110, 0, 20, 0, "mobile forward"), (60, 5, 0, 0, 90, 0, 20, 0, "target striker"),
    ],
)
def test_roles_follow_from_traits(spark, depth, wide, touches, press, dist, between, reach, push, role):
    row = spark.createDataFrame([tuple(map(float, (depth, wide, touches, press, dist, between, reach, push)))], "def_depth_m double, wideness_m double, touches_per_min double, press_per_min double, dist_per_min double, betweenness double, x_range_m double, push_up_m double")
    assert row.select(embedding.role_name().alias("r")).head()["r"] == role


def test_nominal_and_actual_families(spark):
    roles = spark.createDataFrame([("m1", 1, "home", 0, "winger"), ("m1", 2, "home", 0, "winger"), ("m1", 3, "home", 1, "target striker"), ("m1", 4, "home", 1, "winger")], "match_id string, entity_id int, team string, cluster int, role string")
    windows = spark.createDataFrame([("m1", [1, 2, 3], ["RB", "RW", "ST"]), ("m1", [1, 2, 3], ["LW", "LW", "CB"]), ("m1", [3], ["CB"])], "match_id string, players array<int>, slots array<string>")
    got = {r["entity_id"]: (r["nominal_slot"], r["nominal_family"], r["role_family"]) for r in embedding.nominal_and_actual(roles, windows).collect()}
    assert got == {3: ("CB", "centre-back", "striker")}  # of RB and LW the first by name is LW


def signatures(rng, n=10, keeper=True):
    rows = [("m1", t, "player", 30.0 if t % 2 else 70.0, (np.array([3.0, 0, 0, 50.0]) * (1 if t % 2 else -1) + rng.normal(0, 0.3, 4)).tolist()) for t in range(n)]
    rows += [("m1", n, "player", 52.0, [0.0, 30.0, 0.0, 0.0])] + ([("m1", n + 1, "player", 3.0, [0.0, -30.0, 9.0, 0.0])] if keeper else [])
    return rows


def test_teams_and_outliers(spark):
    schema = "match_id string, track_id int, class string, mean_x double, signature array<double>"
    rows = signatures(np.random.default_rng(3))
    got = {r["track_id"]: (r["team"], r["class"]) for r in teams.assigned_teams(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[t] == ("home" if t % 2 == 0 else "away", "player") for t in range(10))
    assert got[10] == ("none", "referee") and got[11] == ("away", "goalkeeper")
    # the rule by hand, over both ways to number the clusters
    x = np.array([r[4] for r in rows])
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    best = min((o for o in itertools.product((0, 1), repeat=12) if 0 < sum(o) < 12), key=lambda o: sum(((x[np.array(o) == c] - x[np.array(o) == c].mean(axis=0)) ** 2).sum() for c in (0, 1)))
    own = np.array(best)
    centres = np.stack([x[own == c].mean(axis=0) for c in (0, 1)])
    far = np.linalg.norm(x - centres[own], axis=1)
    inner, gap = np.median(far) + 1e-6, np.linalg.norm(centres[0] - centres[1])
    labels, apart, out = teams.split(np.array([r[4] for r in rows]))
    assert np.isclose(apart, gap / inner) and out.tolist() == (far > max(2.5 * inner, 0.6 * gap)).tolist() and ((labels == own).all() or (labels == 1 - own).all())
    known = [(*r[:2], "goalkeeper" if r[1] == 11 else "referee" if r[1] == 10 else "player", *r[3:]) for r in rows]
    got = {r["track_id"]: (r["team"], r["class"]) for r in teams.assigned_teams(spark.createDataFrame(known, schema)).collect()}
    assert got[10] == ("none", "referee") and got[11] == ("away", "goalkeeper") and got[0] == ("home", "player")
    few = teams.assigned_teams(spark.createDataFrame(rows[:3], schema)).collect()
    assert {r["team"] for r in few} == {"none"}
    samples = spark.createDataFrame([("m1", 1, [1.0, 9.0]), ("m1", 1, [3.0, 1.0]), ("m1", 1, [2.0, 2.0]), ("m2", 1, [5.0, 5.0])], "match_id string, track_id int, signature array<double>")
    assert {(r["match_id"], r["n"], tuple(r["signature"])) for r in teams.track_signatures(samples).collect()} == {("m1", 3, (2.0, 2.0)), ("m2", 1, (5.0, 5.0))}


def plain(value):
    if isinstance(value, float):
        return round(value, 4) + 0.0
    return [plain(v) for v in value] if isinstance(value, list) else value


def test_every_operator_takes_string_ids(spark):
    """The derived match under the id 'm1' gives what it gives under 0."""
    results = []
    for name in (0, "m1"):
        key = F.lit(name).alias("match_id")
        seen = lens.tracking(spark, FOLDER).select(key, *(c for c in lens.tracking(spark, FOLDER).columns if c != "match_id")).cache()
        matches = lens.matches(spark, FOLDER).select(key, "home_sign", "halftime_frame")
        held = possession.possession(seen).cache()
        found = play.events(seen, held).cache()
        kin = movement.kinematics(seen).cache()
        of = possession.players_only(seen).groupBy("match_id", "entity_id").agg(F.mode("team", deterministic=True).alias("team"))
        press, phases, edges = tactics.pressures(kin, held, of), tactics.phases(seen, held, matches).cache(), passing.pass_edges(found).cache()
        central, grids = passing.pass_centrality(edges), passing.xt_grids(found, matches)
        feats = features.player_features(seen, held, phases, kin, movement.movement_profiles(kin), press, passing.pass_nodes(found), central, matches, least_minutes=0.1).cache()
        places = formations.window_places(seen, held, matches)
        moving = kin.select("match_id", "frame", "entity_id", "x", "y").join(of, ["match_id", "entity_id"]).withColumn("class", F.lit("player"))
        assigned = marking.assignments(moving, phases)
        rows = embedding.style_rows(feats, embedding.player_maps(seen, matches))
        vectors = embedding.match_vectors(rows)
        tables = {
            "central": central, "grids": grids, "player_xt": passing.player_xt(found, grids, matches), "features": feats, "windows": formations.formation_windows(places), "pairs": marking.pairs(assigned), "control": control.control_frames(control.every_nth_frame(kin).join(of, ["match_id", "entity_id"])),
            "areas": control.voronoi_areas(possession.players_only(seen).where("frame < 40").select("match_id", "frame", "team", "x", "y")), "similar": style.similar_players(feats), "quality": tracks.quality(seen), "ppda": tactics.ppda(found, press, matches),
            "agreement": evaluation.owner_agreement(held, held.select("match_id", "frame", "team")), "vectors": vectors, "shape": tactics.shape(seen, held, matches), "counts": play.event_counts(found), "summary": report.team_running(movement.movement_profiles(kin), of),
        }
        results.append({n: sorted(str([plain(v) for v in r]) for r in t.drop("match_id").collect()) for n, t in tables.items()})
        assert all(dict(t.dtypes).get("match_id", "string") == ("int" if name == 0 else "string") for t in tables.values())
    for n in results[0]:
        assert results[0][n] == results[1][n], n


def test_player_grids_are_the_blurred_counts(spark):
    """A product for each axis gives what passes over tables of cells give, edges included; who is only off the pitch has no map."""
    places = [(1, 0.0, 0.0), (1, 105.0, 68.0), (1, 0.1, 67.9), (1, 52.5, 34.0), (1, 52.6, 34.0), (1, 110.0, 34.0), (2, 3.0, 30.0), (3, -5.0, 10.0)]
    seen = spark.createDataFrame([(0, f, e, "player", "home", x, y) for f, (e, x, y) in enumerate(places)], "match_id int, frame int, entity_id int, class string, team string, x double, y double")
    matches = spark.createDataFrame([(0, 1, 3000)], "match_id int, home_sign int, halftime_frame int")
    counts = spark.createDataFrame([(0, 1, 0, 0, 1), (0, 1, 15, 23, 1), (0, 1, 15, 0, 1), (0, 1, 8, 12, 2), (0, 2, 7, 0, 1)], "match_id int, entity_id int, iy int, ix int, n long")
    want = {tuple(r[:4]): r["v"] for r in movement.blurred(counts, "n", "match_id", "entity_id", sigma=1.0, nx=24, ny=16).collect()}
    maps = embedding.player_maps(seen, matches)
    found = {tuple(r[:4]): r["v"] for r in maps.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert maps._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    rows = spark.createDataFrame([(0, e, 0.0) for e in (1, 2, 3)], "match_id int, entity_id int, z double")
    features_ = rows.select("match_id", "entity_id", *(F.col("z").alias(n) for n in embedding.NAMES))
    a, b = ({r["entity_id"]: r["x"] for r in embedding.style_rows(features_, m).collect()} for m in (maps, embedding.player_grids(seen, matches)))
    assert a.keys() == b.keys() == {1, 2, 3} and all(np.allclose(a[e], b[e], rtol=0, atol=1e-9) for e in a) and not any(a[3])


@pytest.mark.parametrize("name", ["similar_players", "similarity_by_group"])
def test_similarities_read_stored_features(spark, name):
    """Scaling and pairing read the features four times; the matches themselves must not be read for each."""
    from touchline.plans import queries

    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan
