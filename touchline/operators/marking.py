"""Who marks whom: optimal assignment of defenders to attackers, coupling, stability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.assignment import assign_many
from ..functions.pitch import distance
from .possession import players_only

MAX_PAIR_M, STEP_S, WINDOW, FEWEST = 12.0, 1.0, 50, 5
MAN, ZONAL, STABLE = 0.72, 0.50, 0.60


def _defence(phases: DataFrame) -> DataFrame:
    """(match_id, frame, phase, defending_team) of frames with a team on the ball."""
    return phases.where("poss_team <> 'none'").select("match_id", "frame", "phase", F.when(F.col("poss_team") == "home", "away").otherwise("home").alias("defending_team"))


def assignments(tracking: DataFrame, phases: DataFrame, open_play: bool = True, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, defending_team, defender_id, attacker_id, dist_m): pairs of least total distance in sampled frames, each frame one row of two short arrays."""
    step = max(1, int(STEP_S * cfg.fps))
    frames = _defence(phases).where("phase <> 'set_piece'" if open_play else "true")
    order = Window.partitionBy("match_id", "defending_team").orderBy("frame")
    sampled = frames.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") % step == 0).select("match_id", "frame", "defending_team")
    rows = players_only(tracking, goalkeepers=False).select("match_id", "frame", "entity_id", "team", "x", "y").join(sampled.hint("shuffle_hash"), ["match_id", "frame"])

    one = F.struct("entity_id", "x", "y")
    own = F.col("team") == F.col("defending_team")
    arrays = rows.groupBy("match_id", "frame", "defending_team").agg(F.sort_array(F.collect_list(F.when(own, one))).alias("own"), F.sort_array(F.collect_list(F.when(~own, one))).alias("other")).where((F.size("own") >= FEWEST) & (F.size("other") >= FEWEST))

    def work(batches):
        for batch in batches:
            sides = [batch.column(c) for c in ("own", "other")]
            n, m = (side.value_lengths().to_numpy() for side in sides)
            starts = [np.cumsum(v) - v for v in (n, m)]
            ids = [side.flatten().field("entity_id").to_numpy() for side in sides]
            places = [np.stack([side.flatten().field(c).to_numpy() for c in "xy"], axis=1) for side in sides]
            found = []
            # frames of equally many players are assigned at once
            for size in sorted(set(zip(n.tolist(), m.tolist()))):
                at = np.flatnonzero((n == size[0]) & (m == size[1]))
                own, other = (start[at, None] + np.arange(k) for start, k in zip(starts, size))
                apart = places[0][own][:, :, None] - places[1][other][:, None]
                cost = np.hypot(apart[..., 0], apart[..., 1])
                cols = assign_many(np.where(cost > MAX_PAIR_M, cost + 1e5, cost))
                dist = np.where(cols >= 0, np.take_along_axis(cost, np.maximum(cols, 0)[:, :, None], axis=2)[:, :, 0], np.inf)
                i, r = np.nonzero(dist <= MAX_PAIR_M)
                found.append((at[i], r, ids[0][own[i, r]], ids[1][other[i, cols[i, r]]], dist[i, r]))
            at, r, own, other, dist = (np.concatenate(v) for v in zip(*found)) if found else [np.zeros(0, int)] * 5
            order = np.lexsort((r, at))
            key = batch.select(["match_id", "frame", "defending_team"]).take(pa.array(at[order], pa.int64()))
            cells = [pa.array(own[order], pa.int32()), pa.array(other[order], pa.int32()), pa.array([round(d, 2) for d in dist[order].tolist()], pa.float64())]
            yield pa.RecordBatch.from_arrays([*key.columns, *cells], names=[*key.schema.names, "defender_id", "attacker_id", "dist_m"])

    kinds = dict(rows.dtypes)
    return arrays.mapInArrow(work, f"match_id {kinds['match_id']}, frame {kinds['frame']}, defending_team string, defender_id int, attacker_id int, dist_m double")


def pairs(assigned: DataFrame) -> DataFrame:
    """(match_id, defending_team, defender_id, attacker_id, share, mean_dist_m, n): each defender's most frequent attacker, the lowest id on ties."""
    key = ["match_id", "defending_team", "defender_id"]
    # distances are whole centimetres, whose sum is the same in every order
    mean = F.sum(F.round(100 * F.col("dist_m")).cast("long")) / (100 * F.count("*"))
    counted = assigned.groupBy(*key, "attacker_id").agg(F.count("*").alias("c"), mean.alias("mean_dist_m"))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "attacker_id"))
    total = F.sum("c").over(Window.partitionBy(*key))
    return counted.withColumns({"r": best, "n": total}).where("r = 1").select(*key, "attacker_id", (F.col("c") / F.col("n")).alias("share"), "mean_dist_m", "n")


def stability(assigned: DataFrame, window: int = WINDOW) -> DataFrame:
    """(match_id, defending_team, defender_id, stability): mean share of the most frequent attacker over half-overlapping windows of a defender's assignments."""
    key = ["match_id", "defending_team", "defender_id"]
    group = Window.partitionBy(*key)
    rows = assigned.withColumns({"i": F.row_number().over(group.orderBy("frame")) - 1, "n": F.count("*").over(group)}).where(F.col("n") >= max(4, window // 2))
    w = F.least(F.lit(window), F.col("n"))
    step = F.greatest(F.lit(1), F.floor(w / 2)).cast("int")
    # row i lies in the windows k with k*step <= i < k*step + w and k*step <= n - w
    lowest = F.greatest(F.lit(0), F.ceil((F.col("i") - w + 1) / step)).cast("int")
    highest = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - w) / step)).cast("int")
    placed = rows.where(lowest <= highest).withColumns({"w": w, "k": F.explode(F.sequence(lowest, highest))})
    counts = placed.groupBy(*key, "k", "attacker_id").agg(F.count("*").alias("c"), F.first("w").alias("w"))
    return counts.groupBy(*key, "k").agg((F.max("c") / F.first("w")).alias("s")).groupBy(*key).agg(F.avg("s").alias("stability"))


def residuals(tracking: DataFrame, phases: DataFrame) -> DataFrame:
    """(match_id, frame, defending_team, entity_id, team, rx, ry): positions against the team's centroid in frames with a team on the ball."""
    rows = players_only(tracking, goalkeepers=False).select("match_id", "frame", "entity_id", "team", "x", "y").join(_defence(phases).select("match_id", "frame", "defending_team"), ["match_id", "frame"])
    group = Window.partitionBy("match_id", "frame", "team")
    return rows.select("match_id", "frame", "defending_team", "entity_id", "team", (F.col("x") - F.avg("x").over(group)).alias("rx"), (F.col("y") - F.avg("y").over(group)).alias("ry"))


def coupling(found: DataFrame, tracking: DataFrame, phases: DataFrame, fewest: int = 30) -> DataFrame:
    """(match_id, defending_team, defender_id, coupling): correlation of a defender's residuals with those of the modal attacker, x and y as one series."""
    rest = residuals(tracking, phases)
    own = rest.select("match_id", "frame", "defending_team", F.col("entity_id").alias("defender_id"), F.col("rx").alias("dx"), F.col("ry").alias("dy"))
    other = rest.select("match_id", "frame", F.col("entity_id").alias("attacker_id"), "rx", "ry")
    named = found.select("match_id", "defending_team", "defender_id", "attacker_id")
    both = own.join(named, ["match_id", "defending_team", "defender_id"]).join(other, ["match_id", "frame", "attacker_id"])
    series = both.select("match_id", "defending_team", "defender_id", F.explode(F.array(F.struct(F.col("dx").alias("d"), F.col("rx").alias("a")), F.struct(F.col("dy").alias("d"), F.col("ry").alias("a")))).alias("v"))
    return series.groupBy("match_id", "defending_team", "defender_id").agg(F.corr("v.d", "v.a").alias("coupling"), F.count("*").alias("m")).where(F.col("m") >= 2 * fewest).drop("m")


def spread(tracking: DataFrame, phases: DataFrame, fewest: int = 10) -> DataFrame:
    """(match_id, entity_id, spread_m): how widely a defender roams while the team defends (sample deviations)."""
    rows = players_only(tracking, goalkeepers=False).join(_defence(phases).select("match_id", "frame", F.col("defending_team").alias("team")), ["match_id", "frame", "team"])
    grouped = rows.groupBy("match_id", "entity_id").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    return grouped.where(F.col("n") >= fewest).select("match_id", "entity_id", F.hypot("sx", "sy").alias("spread_m"))


def marking(assigned: DataFrame, tracking: DataFrame, phases: DataFrame, window: int = WINDOW) -> DataFrame:
    """(match_id, defending_team, defender_id, attacker_id, share, mean_dist_m, stability, coupling, man_score, team_score, scheme)."""
    key = ["match_id", "defending_team", "defender_id"]
    found = pairs(assigned).where(F.col("n") >= max(6, window // 25))
    rows = found.join(stability(assigned, window), key).join(coupling(found, tracking, phases), key, "left")
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("coupling", F.lit(0.0))))
    man = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("stability") * (0.25 + 0.75 * bounded)))
    team = F.avg("man_score").over(Window.partitionBy("match_id", "defending_team"))
    scored = rows.withColumn("man_score", man).withColumn("team_score", team)
    return scored.withColumn("scheme", F.when(F.col("team_score") >= MAN, "man").when(F.col("team_score") <= ZONAL, "zonal").otherwise("hybrid")).drop("n")
