"""Formations of time windows by optimal matching to templates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.assignment import assign_many, hull_area
from ..functions.direction import directed, sign
from ..functions.pitch import attacking_x, attacking_y
from .possession import players_only

#: Means are rounded a hair above their value, so that halves go up in every engine.
HAIR = 1e-9
#: The places of each formation's ten outfield players (x forward, y across, from 0 to 1) and their labels.
FORMATIONS = {
    "4-4-2": [(0.18, 0.18, "RB"), (0.15, 0.40, "RCB"), (0.15, 0.60, "LCB"), (0.18, 0.82, "LB"), (0.45, 0.15, "RM"), (0.42, 0.40, "RCM"), (0.42, 0.60, "LCM"), (0.45, 0.85, "LM"), (0.72, 0.42, "RST"), (0.72, 0.58, "LST")],
    "4-3-3": [(0.18, 0.18, "RB"), (0.15, 0.40, "RCB"), (0.15, 0.60, "LCB"), (0.18, 0.82, "LB"), (0.38, 0.50, "DM"), (0.50, 0.32, "RCM"), (0.50, 0.68, "LCM"), (0.72, 0.15, "RW"), (0.78, 0.50, "ST"), (0.72, 0.85, "LW")],
    "4-2-3-1": [(0.18, 0.18, "RB"), (0.15, 0.40, "RCB"), (0.15, 0.60, "LCB"), (0.18, 0.82, "LB"), (0.38, 0.40, "RDM"), (0.38, 0.60, "LDM"), (0.58, 0.15, "RAM"), (0.60, 0.50, "CAM"), (0.58, 0.85, "LAM"), (0.78, 0.50, "ST")],
    "4-5-1": [(0.18, 0.18, "RB"), (0.15, 0.40, "RCB"), (0.15, 0.60, "LCB"), (0.18, 0.82, "LB"), (0.42, 0.12, "RM"), (0.40, 0.35, "RCM"), (0.38, 0.50, "CM"), (0.40, 0.65, "LCM"), (0.42, 0.88, "LM"), (0.72, 0.50, "ST")],
    "3-5-2": [(0.15, 0.28, "RCB"), (0.13, 0.50, "CB"), (0.15, 0.72, "LCB"), (0.45, 0.08, "RWB"), (0.42, 0.35, "RCM"), (0.40, 0.50, "CM"), (0.42, 0.65, "LCM"), (0.45, 0.92, "LWB"), (0.72, 0.42, "RST"), (0.72, 0.58, "LST")],
    "3-4-3": [(0.15, 0.28, "RCB"), (0.13, 0.50, "CB"), (0.15, 0.72, "LCB"), (0.45, 0.12, "RWB"), (0.42, 0.40, "RCM"), (0.42, 0.60, "LCM"), (0.45, 0.88, "LWB"), (0.72, 0.18, "RW"), (0.76, 0.50, "ST"), (0.72, 0.82, "LW")],
    "5-3-2": [(0.20, 0.08, "RWB"), (0.14, 0.30, "RCB"), (0.12, 0.50, "CB"), (0.14, 0.70, "LCB"), (0.20, 0.92, "LWB"), (0.42, 0.32, "RCM"), (0.40, 0.50, "CM"), (0.42, 0.68, "LCM"), (0.70, 0.42, "RST"), (0.70, 0.58, "LST")],
    "5-4-1": [(0.20, 0.08, "RWB"), (0.14, 0.30, "RCB"), (0.12, 0.50, "CB"), (0.14, 0.70, "LCB"), (0.20, 0.92, "LWB"), (0.42, 0.15, "RM"), (0.40, 0.40, "RCM"), (0.40, 0.60, "LCM"), (0.42, 0.85, "LM"), (0.70, 0.50, "ST")],
    "4-1-4-1": [(0.18, 0.18, "RB"), (0.15, 0.40, "RCB"), (0.15, 0.60, "LCB"), (0.18, 0.82, "LB"), (0.32, 0.50, "DM"), (0.52, 0.15, "RM"), (0.50, 0.38, "RCM"), (0.50, 0.62, "LCM"), (0.52, 0.85, "LM"), (0.75, 0.50, "ST")],
    "4-4-1-1": [(0.18, 0.18, "RB"), (0.15, 0.40, "RCB"), (0.15, 0.60, "LCB"), (0.18, 0.82, "LB"), (0.44, 0.15, "RM"), (0.42, 0.40, "RCM"), (0.42, 0.60, "LCM"), (0.44, 0.85, "LM"), (0.60, 0.50, "SS"), (0.76, 0.50, "ST")],
}


def template(name: str) -> tuple[np.ndarray, list[str]]:
    """A formation's ten places and their labels."""
    return np.array([(x, y) for x, y, _ in FORMATIONS[name]]), [label for _, _, label in FORMATIONS[name]]


def formation_slots(name: str, length: float = 105.0, width: float = 68.0, attack_sign: int = 1) -> np.ndarray:
    """A formation's places in metres for a team that attacks in this direction; an unknown name is a KeyError."""
    places = template(name)[0]
    return (places if attack_sign >= 0 else 1 - places) * np.array([length, width])


def match_formations(places: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Nearest templates, their costs and each player's label for many tens of places (b, 10, 2); shapes are centred and scaled, and the first template wins ties."""

    def scaled(a: np.ndarray) -> np.ndarray:
        a = a - a.mean(axis=1, keepdims=True)
        s = a.reshape(len(a), -1).std(axis=1)[:, None, None]
        return a / np.where(s > 1e-9, s, 1)

    if places.shape[1:] != (10, 2):
        raise ValueError("ten places are needed")
    own, known = scaled(places), [template(name) for name in FORMATIONS]
    best, least, taken = np.full(len(own), -1), np.full(len(own), np.inf), np.zeros((len(own), 10), int)
    for i, (slots, _) in enumerate(known):
        cost = ((own[:, :, None] - scaled(slots[None] * np.array([105.0, 68.0]))[:, None]) ** 2).sum(axis=3)
        cols = assign_many(cost)
        total = np.take_along_axis(cost, cols[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        better = total < least
        best[better], least[better], taken[better] = i, total[better], cols[better]
    names = list(FORMATIONS)
    return [names[i] if i >= 0 else "unknown" for i in best], least, [[known[i][1][c] for c in cols] if i >= 0 else [""] * 10 for i, cols in zip(best, taken)]


def match_formation(places: np.ndarray) -> tuple[str, float, list[str]]:
    """Nearest template, its cost and each player's label of one ten."""
    names, costs, labels = match_formations(places[None])
    return names[0], float(costs[0]), labels[0]


def window_places(tracking: DataFrame, held: DataFrame, matches: DataFrame, window_s: float = 20, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, state, start_frame, entity_id, x, y): mean places of the ten most seen players of a window and state, in the direction of attack.

    A window needs half its frames, a state three seconds of them, and ten players.
    """
    win = int(window_s * cfg.fps)
    rows = players_only(tracking, goalkeepers=False).withColumn("start_frame", (F.floor(F.col("frame") / win) * win).cast("int"))
    # players' rows meet the owner by a hash of the frames and are added up unsorted; all else is a row a frame and team, or a window
    owner = held.select("match_id", "frame", F.col("team").alias("owner")).hint("shuffle_hash")
    state = F.when(F.col("owner") == F.col("team"), "in").when(F.col("owner") != "none", "out")
    key, group = ["match_id", "team", "state", "start_frame"], ["match_id", "team", "start_frame"]
    frames = rows.select(*group, "frame").distinct().join(owner, ["match_id", "frame"], "left").withColumn("state", state).groupBy(*key).agg(F.count("frame").alias("n"))
    enough = frames.withColumn("seen", F.sum("n").over(Window.partitionBy(*group))).where((F.col("seen") >= win * 0.5) & (F.col("n") >= 3 * cfg.fps) & F.col("state").isNotNull()).select(*key)
    placed = rows.join(owner, ["match_id", "frame"]).withColumn("state", state).where("state is not null")
    means = placed.groupBy(*key, "entity_id").agg(F.count("*").alias("c"), F.round(F.avg("x") + HAIR, 6).alias("mx"), F.round(F.avg("y") + HAIR, 6).alias("my"))
    ranked = means.join(enough, key).withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "entity_id"))).where("r <= 10").withColumn("k", F.count("*").over(Window.partitionBy(*key))).where("k = 10")
    s = sign("team", "start_frame")
    return directed(ranked, matches).select(*key, "entity_id", attacking_x(F.col("mx"), s).alias("x"), attacking_y(F.col("my"), s).alias("y"))


def formation_windows(places: DataFrame) -> DataFrame:
    """(match_id, team, state, start_frame, formation, cost, hull_area_m2, depth_m, width_m, players, slots); a window is one row of ten places."""
    key = ["match_id", "team", "state", "start_frame"]
    windows = places.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("entity_id", "x", "y"))).alias("ten"))
    names = [*key, "formation", "cost", "hull_area_m2", "depth_m", "width_m", "players", "slots"]

    def work(batches):
        for batch in batches:
            ten = batch.column("ten").flatten()
            if len(ten) != 10 * batch.num_rows:
                raise ValueError("ten places are needed")
            points = np.stack([ten.field("x").to_numpy(), ten.field("y").to_numpy()], axis=1).reshape(-1, 10, 2)
            ids = ten.field("entity_id").to_numpy(zero_copy_only=False).reshape(-1, 10).tolist()
            spans = (points.max(axis=1) - points.min(axis=1)).tolist()
            rows = [(name, round(cost, 3), round(hull_area(own), 1), *(round(v, 1) for v in span), players, slots) for own, span, players, name, cost, slots in zip(points, spans, ids, *(v if isinstance(v, list) else v.tolist() for v in match_formations(points)))]
            kinds = (pa.string(), *[pa.float64()] * 4, pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in key] + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    kinds = dict(places.dtypes)
    schema = f"match_id {kinds['match_id']}, team string, state string, start_frame int, formation string, cost double, hull_area_m2 double, depth_m double, width_m double, players array<int>, slots array<string>"
    return windows.mapInArrow(work, schema)


def formation_summary(windows: DataFrame) -> DataFrame:
    """(match_id, team, state, formation, stability, mean_hull_m2, mean_width_m, mean_depth_m, n_transitions)."""
    order = Window.partitionBy("match_id", "team", "state").orderBy("start_frame")
    changed = windows.withColumn("changed", F.coalesce((F.lag("formation").over(order) != F.col("formation")).cast("int"), F.lit(0)))
    modal = changed.groupBy("match_id", "team", "state").agg(F.mode("formation", deterministic=True).alias("modal"))
    joined = changed.join(modal, ["match_id", "team", "state"])
    return joined.groupBy("match_id", "team", "state", F.col("modal").alias("formation_")).agg(F.avg((F.col("formation") == F.col("modal")).cast("double")).alias("stability"), F.avg("hull_area_m2").alias("mean_hull_m2"), F.avg("width_m").alias("mean_width_m"), F.avg("depth_m").alias("mean_depth_m"), F.sum("changed").alias("n_transitions")).withColumnRenamed("formation_", "formation")
