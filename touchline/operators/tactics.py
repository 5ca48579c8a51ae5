"""Team shape, game phases and pressing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.direction import directed, sign
from ..functions.pitch import attacking_x, distance
from ..functions.sequences import islands, last_known, ordered, ordered_mean
from .formations import HAIR
from .possession import ball_of, players_only


def shape(tracking: DataFrame, held: DataFrame, matches: DataFrame, every: int = 5, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, team, def_line_height_m, depth_m, width_m, centroid_x_att, in_possession) of sampled frames with seven outfield players or more; the line is the second deepest."""
    rows = directed(players_only(tracking, goalkeepers=False).where(F.col("frame") % every == 0), matches).withColumn("xa", attacking_x(F.col("x"), sign()))
    grouped = rows.groupBy("match_id", "frame", "team").agg(F.sort_array(F.collect_list("xa")).alias("xs"), F.avg("xa").alias("centroid_x_att"), (F.max("y") - F.min("y")).alias("width_m")).where(F.size("xs") >= 7)
    owner = held.select("match_id", "frame", F.col("team").alias("owner"))
    joined = grouped.join(owner, ["match_id", "frame"], "left")
    return joined.select("match_id", "frame", "team", F.get("xs", F.lit(1)).alias("def_line_height_m"), (F.array_max("xs") - F.array_min("xs")).alias("depth_m"), "width_m", "centroid_x_att", F.coalesce(F.col("owner") == F.col("team"), F.lit(False)).alias("in_possession"))


def shape_summary(shapes: DataFrame) -> DataFrame:
    """(match_id, team, in_line, out_line, in_depth, out_depth, in_width, out_width, block_label): means to one decimal, halves up; the label goes by the line without the ball."""
    mean = lambda c, own: F.round(F.avg(F.when(F.col("in_possession") == own, F.col(c))) + HAIR, 1)
    cols = [mean(c, own).alias(f"{'in' if own else 'out'}_{n}") for c, n in (("def_line_height_m", "line"), ("depth_m", "depth"), ("width_m", "width")) for own in (True, False)]
    line = F.coalesce("out_line", F.lit(35.0))
    return shapes.groupBy("match_id", "team").agg(*cols).withColumn("block_label", F.when(line > 40, "high line").when(line > 28, "mid block").otherwise("deep block"))


def field_tilt(tracking: DataFrame, held: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, final_third_share, own_third_share, mean_ball_x_att, tilt): tilt is the team's part of both teams' rounded final-third shares."""
    third = cfg.pitch.length / 3
    rows = directed(ball_of(tracking).join(held.where("team <> 'none'").select("match_id", "frame", "team"), ["match_id", "frame"]), matches).withColumn("xa", attacking_x(F.col("ball_x"), sign()))
    shares = rows.groupBy("match_id", "team").agg(F.round(F.avg((F.col("xa") > 2 * third).cast("double")), 3).alias("final_third_share"), F.round(F.avg((F.col("xa") < third).cast("double")), 3).alias("own_third_share"), F.avg("xa").alias("mean_ball_x_att"))
    total = F.sum("final_third_share").over(Window.partitionBy("match_id"))
    return shares.withColumn("tilt", F.when(total > 0, F.col("final_third_share") / total))


def phases(tracking: DataFrame, held: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, poss_team, phase, def_posture) of every ball frame; a team's middle adds its players by id, so that a posture at a bound is the same in every run."""
    p, order = cfg.phases, ordered("match_id")
    ball = ball_of(tracking).join(held.select("match_id", "frame", "team"), ["match_id", "frame"], "left").withColumn("poss_team", F.coalesce("team", F.lit("none"))).drop("team")

    def slope(c: str):
        before, after = F.lag(c).over(order), F.lead(c).over(order)
        return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before, F.lit(0.0))

    vx, vy = slope("ball_x"), slope("ball_y")
    moved = ball.withColumns({"slow": F.sqrt(vx * vx + vy * vy) * cfg.fps < p.dead_mps, "changed": F.coalesce(F.lag("poss_team").over(order) != F.col("poss_team"), F.lit(True))})
    since = last_known(F.when(F.col("changed"), F.struct("frame", "ball_x")), "match_id")
    runs = islands(moved.withColumn("since", since), F.lag("slow").over(order) != F.col("slow"), "run", "match_id")
    placed = runs.withColumn("dead", F.col("slow") & (F.row_number().over(ordered("match_id", "run")) >= p.dead_s * cfg.fps))
    centroid = players_only(tracking, goalkeepers=False).groupBy("match_id", "frame").agg(*(ordered_mean("x", "entity_id", F.col("team") == t).alias(f"c_{t}") for t in ("home", "away")))
    rows = directed(placed.join(centroid, ["match_id", "frame"], "left"), matches)
    s = sign("poss_team")
    xa = attacking_x(F.col("ball_x"), s)
    gain = xa - attacking_x(F.col("since.ball_x"), s)
    third = cfg.pitch.length / 3
    phase = (
        F.when(F.col("poss_team") == "none", "contested").when(F.col("dead"), "set_piece")
        .when(((F.col("frame") - F.col("since.frame")) / cfg.fps <= p.transition_s) & (xa > third) & (gain >= p.transition_gain_m), "transition_attack")
        .when(xa < third, "build_up").when(xa < 2 * third, "progression").otherwise("final_third_attack")
    )
    against = F.when(F.col("poss_team") == "home", F.col("c_away")).when(F.col("poss_team") == "away", F.col("c_home"))
    own = attacking_x(against, -s)
    posture = F.when(F.col("poss_team") == "none", "none").when(own > p.high_press_m, "high_press").when(own < p.low_block_m, "low_block").otherwise("mid_block")
    return rows.select("match_id", "frame", "poss_team", phase.alias("phase"), posture.alias("def_posture"))


def phase_summary(found: DataFrame) -> DataFrame:
    """(match_id, scope, value, share): phases of all frames, phases by possessing team, and postures of the team without the ball."""
    defending = F.when(F.col("poss_team") == "home", "away").when(F.col("poss_team") == "away", "home")
    scopes = F.array(
        F.struct(F.lit("all").alias("scope"), F.col("phase").alias("value")),
        F.struct(F.when(F.col("poss_team") != "none", F.col("poss_team")).alias("scope"), F.col("phase").alias("value")),
        F.struct(F.concat(defending, F.lit("_posture")).alias("scope"), F.col("def_posture").alias("value")),
    )
    counted = found.select("match_id", F.explode(scopes).alias("s")).where("s.scope is not null").groupBy("match_id", "s.scope", "s.value").agg(F.count("*").alias("n"))
    return counted.select("match_id", "scope", "value", (F.col("n") / F.sum("n").over(Window.partitionBy("match_id", "scope"))).alias("share"))


def pressures(kin: DataFrame, held: DataFrame, teams: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, presser_id, presser_team, target_id, dist_m, closing_mps, x, y, duration_frames).

    An opponent near the holder who closes in, or is very near. Frames of one
    pair that follow each other are one event. The join is on the frame, with
    the holder's one row against all players; the holder's place is taken from
    these by a window, so that the motion is computed once.
    """
    p = cfg.pressing
    moving = kin.select("match_id", "frame", "entity_id", "x", "y", "vx", "vy").join(teams.select("match_id", "entity_id", F.col("team").alias("p_team")), ["match_id", "entity_id"])
    holder = held.where("holder_id >= 0").select("match_id", "frame", F.col("holder_id").alias("target_id"), "team")
    frame = Window.partitionBy("match_id", "frame")
    own = lambda c: F.max(F.when(F.col("entity_id") == F.col("target_id"), F.col(c))).over(frame)
    near = holder.join(moving, ["match_id", "frame"]).withColumns({"hx": own("x"), "hy": own("y")}).where("p_team <> team and hx is not null")
    d = distance("x", "y", "hx", "hy")
    closing = F.when(F.col("d") > 1e-6, (-(F.col("x") - F.col("hx")) * F.col("vx") - (F.col("y") - F.col("hy")) * F.col("vy")) / F.col("d")).otherwise(0.0)
    close = near.withColumn("d", d).where(F.col("d") <= p.radius_m).withColumn("closing", closing).where((F.col("closing") >= p.closing_mps) | (F.col("d") <= p.near_m))
    key = ["match_id", "entity_id", "target_id"]
    apart = islands(close, (F.col("frame") - F.lag("frame").over(ordered(*key))) > cfg.fps * p.gap_s, "event", *key)
    return apart.groupBy(*key, "event").agg(F.min("frame").alias("frame"), F.min_by("p_team", "frame").alias("presser_team"), F.min("d").alias("dist_m"), F.max("closing").alias("closing_mps"), F.avg("hx").alias("x"), F.avg("hy").alias("y"), F.count("*").alias("duration_frames")).select("match_id", "frame", F.col("entity_id").alias("presser_id"), "presser_team", "target_id", "dist_m", "closing_mps", "x", "y", "duration_frames")


def _other(team: str):
    return F.when(F.col(team) == "home", "away").otherwise("home")


def ppda(events: DataFrame, press: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, opp_buildup_passes, defensive_actions, ppda): passes that the opponent may make for each defensive action in its own zone; null without an action."""
    zone = cfg.pressing.ppda_share * cfg.pitch.length
    passes = directed(events.where("type = 'pass'"), matches).select("match_id", _other("team").alias("team"), F.when(attacking_x(F.col("x"), sign()) <= zone, 1).otherwise(0).alias("passes"), F.lit(0).alias("actions"))
    won = events.where("type = 'turnover'").select("match_id", "frame", "team", "x").unionByName(press.select("match_id", "frame", F.col("presser_team").alias("team"), "x"))
    acted = directed(won, matches).select("match_id", "team", F.lit(0).alias("passes"), F.when(attacking_x(F.col("x"), -sign()) <= zone, 1).otherwise(0).alias("actions"))
    both = passes.unionByName(acted).groupBy("match_id", "team").agg(F.sum("passes").alias("opp_buildup_passes"), F.sum("actions").alias("defensive_actions"))
    return both.withColumn("ppda", F.col("opp_buildup_passes") / F.nullif("defensive_actions", F.lit(0)))


def pressing_summary(press: DataFrame, events: DataFrame, n_frames: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, pressures, pressures_per_min, press_height_mean_m, high_press_share, press_to_turnover_rate).

    Whether a turnover follows in time is a look ahead over both kinds of rows
    in one ordered window, not a join on a range.
    """
    rows = press.select("match_id", F.col("presser_team").alias("team"), "frame", "x", F.lit(1).alias("press")).unionByName(events.where("type = 'turnover'").select("match_id", "team", "frame", F.lit(None).cast("double").alias("x"), F.lit(0).alias("press")))
    ahead = Window.partitionBy("match_id", "team").orderBy("frame").rangeBetween(0, int(cfg.pressing.win_s * cfg.fps))
    seen = directed(rows.withColumn("won", F.max(1 - F.col("press")).over(ahead)).where("press = 1"), matches).withColumn("xa", attacking_x(F.col("x"), sign()))
    grouped = seen.groupBy("match_id", "team").agg(F.count("*").alias("pressures"), F.avg("xa").alias("press_height_mean_m"), F.avg((F.col("xa") > 2 * cfg.pitch.length / 3).cast("double")).alias("high_press_share"), F.avg(F.col("won").cast("double")).alias("press_to_turnover_rate"))
    minutes = n_frames.select("match_id", (F.col("n_frames") / cfg.fps / 60).alias("m"))
    return grouped.join(minutes, "match_id").select("match_id", "team", "pressures", (F.col("pressures") / F.col("m")).alias("pressures_per_min"), "press_height_mean_m", "high_press_share", "press_to_turnover_rate")
