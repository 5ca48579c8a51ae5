"""Who has the ball."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.pitch import distance
from ..functions.sequences import islands, last_known, ordered


def players_only(tracking: DataFrame, goalkeepers: bool = True) -> DataFrame:
    """Rows of players (and goalkeepers) of either team with a position."""
    classes = ["player", "goalkeeper"] if goalkeepers else ["player"]
    return tracking.where(F.col("class").isin(classes) & F.col("team").isin("home", "away") & F.col("x").isNotNull() & F.col("y").isNotNull())


def modal(tracking: DataFrame, *columns: str) -> DataFrame:
    """(match_id, entity_id and the columns): each player's most frequent value that is not null, the least on ties.

    Rows are counted by all values first, so that only some rows a player are compared.
    """
    key = ["match_id", "entity_id"]
    counted = players_only(tracking).groupBy(*key, *columns).agg(F.count("*").alias("n"))
    sums = counted.withColumns({f"_{c}": F.sum("n").over(Window.partitionBy(*key, c)) for c in columns})
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(f"_{c}")).alias("n"), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    return sums.groupBy(*key).agg(*best)


def ball_of(tracking: DataFrame) -> DataFrame:
    """(match_id, frame, ball_x, ball_y)."""
    return tracking.where("entity_id = -1 and x is not null and y is not null").select("match_id", "frame", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))


def nearest_to_ball(tracking: DataFrame) -> DataFrame:
    """(match_id, frame, ball_x, ball_y, entity_id, team, dist_m): the nearest player of each frame with a ball; ties go to the lowest id.

    One aggregation over (match, frame) of players and ball together, so the
    ball needs no join of its own.
    """
    rows = players_only(tracking).select("match_id", "frame", "entity_id", "team", "x", "y").join(ball_of(tracking), ["match_id", "frame"])
    best = F.min(F.struct(distance("x", "y", "ball_x", "ball_y").alias("d"), "entity_id", "team", "ball_x", "ball_y")).alias("b")
    return rows.groupBy("match_id", "frame").agg(best).select("match_id", "frame", "b.ball_x", "b.ball_y", "b.entity_id", "b.team", F.col("b.d").alias("dist_m"))


def possession(tracking: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, holder_id, team, dist_m): hysteresis over rows.

    A candidate within the radius takes over after so many rows in a row; the
    first ever takes over at once; a loose ball stays with the last holder.
    """
    near = nearest_to_ball(tracking).withColumn("cand", F.when(F.col("dist_m") <= cfg.possession.radius_m, F.col("entity_id")).otherwise(-1))
    runs = islands(near, F.lag("cand").over(ordered("match_id")) != F.col("cand"), "run", "match_id")
    in_run = F.row_number().over(ordered("match_id", "run"))
    first = F.min(F.when(F.col("cand") != -1, F.col("frame"))).over(Window.partitionBy("match_id"))
    marked = runs.withColumns({"pos": in_run, "first": first})
    takes = (F.col("cand") != -1) & ((F.col("pos") == cfg.possession.hysteresis_rows) | (F.col("frame") == F.col("first")))
    held = last_known(F.when(takes, F.struct(F.col("cand").alias("id"), F.col("team").alias("team"))), "match_id")
    return marked.withColumn("h", held).select("match_id", "frame", F.coalesce("h.id", F.lit(-1)).alias("holder_id"), F.coalesce("h.team", F.lit("none")).alias("team"), "dist_m")


def spells(held: DataFrame) -> DataFrame:
    """(match_id, holder_id, team, start_frame, end_frame): runs of one holder."""
    runs = islands(held, F.lag("holder_id").over(ordered("match_id")) != F.col("holder_id"), "spell", "match_id")
    return runs.where("holder_id <> -1").groupBy("match_id", "spell", "holder_id").agg(F.min_by("team", "frame").alias("team"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("spell")


def possession_summary(held: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, share, n_spells, mean_spell_s, max_spell_s)."""
    frames = held.where("team <> 'none'").groupBy("match_id", "team").agg(F.count("*").alias("frames"))
    seconds = (F.col("end_frame") - F.col("start_frame") + 1) / cfg.fps
    lengths = spells(held).groupBy("match_id", "team").agg(F.count("*").alias("n_spells"), F.avg(seconds).alias("mean_spell_s"), F.max(seconds).alias("max_spell_s"))
    total = frames.groupBy("match_id").agg(F.sum("frames").alias("total"))
    return frames.join(total, "match_id").join(lengths, ["match_id", "team"]).select("match_id", "team", (F.col("frames") / F.col("total")).alias("share"), "n_spells", "mean_spell_s", "max_spell_s")


def rolling_possession(held: DataFrame, seconds: float = 30, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, home_share): the home team's share of the last rows; null until a third of the window is there."""
    rows = int(seconds * cfg.fps)
    window = ordered("match_id").rowsBetween(-(rows - 1), 0)
    counted = held.withColumns({"n": F.count("*").over(window), "s": F.avg((F.col("team") == "home").cast("double")).over(window)})
    return counted.select("match_id", "frame", F.when(F.col("n") >= rows // 3, F.col("s")).alias("home_share"))
