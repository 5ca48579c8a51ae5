"""What a player does in a match, in five groups of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.assignment import hull, hull_area, outer
from ..functions.direction import directed, sign
from ..functions.pitch import attacking_x, attacking_y
from ..functions.sequences import ordered
from .possession import players_only

KEY = ["match_id", "entity_id"]
#: Rows that are reduced to hulls at once, about.
CHUNK = 200_000

#: Phases whose share of a player's frames counts while its own team has the ball.
TIMED_PHASES = ("build_up", "progression", "final_third_attack", "transition_attack", "set_piece")

#: Features by group; the names are columns of ``player_features``.
GROUPS = {
    "spatial": ("mean_x", "mean_y", "std_x", "std_y", "wideness", "hull_area", "x_range", "y_range"),
    "movement": ("dist_per_min", "top_speed", "speed_p50", "speed_p90", "sprints_per_min", "hi_dist_per_min", "accel_p90", "dir_changes_per_min"),
    "involvement": ("touches_per_min", "poss_time_share", "mean_dist_ball", "near_ball_share", "press_per_min", *(f"time_{p}" for p in TIMED_PHASES), "time_defending"),
    "interaction": ("dist_to_centroid", "net_volume", "net_betweenness", "net_eigenvector"),
    "phase": ("att_mean_x", "att_mean_y", "def_mean_x", "def_mean_y", "push_up_delta", "tuck_in_delta"),
}


def outfield_rows(tracking: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of outfield players with xa and ya in the direction of attack."""
    s = sign()
    return directed(players_only(tracking, goalkeepers=False), matches).withColumns({"xa": attacking_x(F.col("x"), s), "ya": attacking_y(F.col("y"), s)})


def hull_areas(points: DataFrame) -> DataFrame:
    """(match_id, entity_id, hull_area) of points (match_id, entity_id, xa, ya); 0 below four points.

    Tasks first reduce their own rows to hulls, many at a time, so that only
    corners are left: the hull of all points is the hull of the parts' hulls.
    """

    def reduced(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in KEY])
        ids, xy = table.select(KEY).to_pandas(), np.stack([table.column(c).to_numpy() for c in ("xa", "ya")], axis=1)
        starts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
        rings = [hull(outer(part)) for part in np.split(xy, starts[1:])]
        sizes = np.array([len(r) for r in rings])
        firsts, n = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int64)
        n[firsts] = np.diff([*starts, len(xy)])
        key = [table.column(k).take(pa.array(np.repeat(starts, sizes))).combine_chunks() for k in KEY]
        return pa.RecordBatch.from_arrays([*key, *(pa.array(v) for v in np.concatenate(rings).T), pa.array(n)], names=[*KEY, "xa", "ya", "n"])

    def corners(batches):
        waiting, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting, rows = [*waiting, batch], rows + batch.num_rows
            if rows >= CHUNK:
                yield reduced(waiting)
                waiting, rows = [], 0
        if waiting:
            yield reduced(waiting)

    def areas(batches):
        for batch in batches:
            found = batch.column("corners")
            xy = np.stack([found.flatten().field(c).to_numpy() for c in ("xa", "ya")], axis=1)
            parts = np.split(xy, np.cumsum(found.value_lengths().to_numpy())[:-1]) if batch.num_rows else []
            area = [hull_area(part) if n >= 4 else 0.0 for part, n in zip(parts, batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(area, pa.float64())], names=[*KEY, "hull_area"])

    kind = dict(points.dtypes)["match_id"]
    parts = points.select(*KEY, "xa", "ya").mapInArrow(corners, f"match_id {kind}, entity_id int, xa double, ya double, n long")
    # areas cost more than the few bytes of their corners tell, so the number of tasks is given
    dealt = parts.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    rings = dealt.groupBy(*KEY).agg(F.collect_list(F.struct("xa", "ya")).alias("corners"), F.sum("n").alias("n"))
    return rings.mapInArrow(areas, f"match_id {kind}, entity_id int, hull_area double")


def touches(held: DataFrame, gap: int = 3) -> DataFrame:
    """(match_id, entity_id, n_touches, n_held): spells of holding the ball, parted by more than ``gap`` frames, and frames held."""
    rows = held.where("holder_id >= 0").select("match_id", F.col("holder_id").alias("entity_id"), "frame")
    return rows.withColumn("_new", F.coalesce(F.col("frame") - F.lag("frame").over(ordered(*KEY)) > gap, F.lit(True)).cast("int")).groupBy(*KEY).agg(F.sum("_new").alias("n_touches"), F.count("*").alias("n_held"))


def player_features(tracking: DataFrame, held: DataFrame, phases: DataFrame, kin: DataFrame, profiles: DataFrame, press: DataFrame, nodes: DataFrame, central: DataFrame, matches: DataFrame, least_minutes: float = 1.0, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, team, minutes, and the columns of GROUPS) of outfield players seen for ``least_minutes`` or longer.

    Everything is summed to a row per player before the parts are joined. A
    player's places with and without the ball are its overall ones where it
    has ten frames or fewer of the kind; a player in no pass has no volume
    and no centrality.
    """
    group = Window.partitionBy("match_id", "frame", "team")
    ball = tracking.where("entity_id = -1").select("match_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    when = phases.select("match_id", "frame", "poss_team", "phase")
    placed = outfield_rows(tracking, matches).withColumns({"cx": F.avg("x").over(group), "cy": F.avg("y").over(group)}).join(ball, ["match_id", "frame"], "left").join(when, ["match_id", "frame"], "left")
    rows = placed.withColumns({"db": F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), "dc": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))})
    att = F.col("poss_team") == F.col("team")
    defending = (F.col("poss_team") != F.col("team")) & (F.col("poss_team") != "none")
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    spread = lambda c: F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))
    enough = lambda c, of: F.when(F.count(F.when(of, 1)) > 10, F.avg(F.when(of, F.col(c)))).otherwise(F.avg(c))
    base = rows.groupBy(*KEY).agg(
        F.mode("team", deterministic=True).alias("team"), F.count("*").alias("n_seen"),
        F.avg("xa").alias("mean_x"), F.avg("ya").alias("mean_y"), F.stddev_pop("xa").alias("std_x"), F.stddev_pop("ya").alias("std_y"),
        F.avg(F.abs(F.col("ya") - cfg.pitch.width / 2)).alias("wideness"), spread("xa").alias("xs"), spread("ya").alias("ys"),
        F.coalesce(F.avg("db"), F.lit(40.0)).alias("mean_dist_ball"), share(F.col("db") < 15).alias("near_ball_share"), F.avg("dc").alias("dist_to_centroid"),
        *(share((F.col("phase") == p) & att).alias(f"time_{p}") for p in TIMED_PHASES), share(defending).alias("time_defending"),
        enough("xa", att).alias("att_mean_x"), enough("ya", att).alias("att_mean_y"), enough("xa", defending).alias("def_mean_x"), enough("ya", defending).alias("def_mean_y"),
    )
    base = base.withColumns({f"{c}_range": F.get(f"{c}s", F.lit(1)) - F.get(f"{c}s", F.lit(0)) for c in ("x", "y")})
    both = kin.groupBy(*KEY).agg(F.percentile("speed", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    speeds = both.select(*KEY, F.get("p", F.lit(0)).alias("speed_p50"), F.get("p", F.lit(1)).alias("speed_p90"))
    moved = profiles.select(*KEY, F.col("minutes").alias("m"), "distance_m", "top_speed", "n_sprints", "hi_distance_m", "accel_p90", "n_turns")
    pressed = press.groupBy("match_id", F.col("presser_id").alias("entity_id")).agg(F.count("*").alias("n_press"))
    passing = nodes.select(*KEY, "volume").join(central.select(*KEY, "betweenness", "eigenvector"), KEY, "left")
    joined = base.withColumn("minutes", F.col("n_seen") / cfg.fps / 60).where(F.col("minutes") >= least_minutes)
    for part in (hull_areas(outfield_rows(tracking, matches)), touches(held), speeds, moved, pressed, passing):
        joined = joined.join(part, KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    least = F.greatest(F.col("minutes"), F.lit(0.1))
    inner = lambda c: F.abs(F.col(c) - cfg.pitch.width / 2)
    full = joined.withColumns({
        "dist_per_min": zero(F.col("distance_m") / F.col("m")), "top_speed": zero(F.col("top_speed")), "speed_p50": zero(F.col("speed_p50")), "speed_p90": zero(F.col("speed_p90")),
        "sprints_per_min": zero(F.col("n_sprints") / F.col("m")), "hi_dist_per_min": zero(F.col("hi_distance_m") / least), "accel_p90": zero(F.col("accel_p90")), "dir_changes_per_min": zero(F.col("n_turns") / F.col("m")),
        "touches_per_min": zero(F.col("n_touches") / F.col("minutes")), "poss_time_share": zero(F.col("n_held") / F.col("n_seen")), "press_per_min": zero(F.col("n_press") / F.col("minutes")),
        "net_volume": zero(F.col("volume") / least), "net_betweenness": zero(F.col("betweenness")), "net_eigenvector": zero(F.col("eigenvector")),
        "push_up_delta": F.col("att_mean_x") - F.col("def_mean_x"), "tuck_in_delta": inner("att_mean_y") - inner("def_mean_y"),
    })
    return full.select(*KEY, "team", "minutes", *(n for names in GROUPS.values() for n in names))
