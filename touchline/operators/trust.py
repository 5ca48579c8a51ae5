"""How far a match's perception can be trusted: calibration, ball, tracks and teams, with notes on what is poor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import grade

#: Bounds of high and medium for each signal; errors are better if smaller.
CALIBRATED, ERROR_PX, BALL_SEEN, TRACK_S, KITS = (0.90, 0.60), (25.0, 60.0), (0.70, 0.45), (5.0, 2.0), (3.0, 1.5)
#: The share of propagated calibrations, and the players a frame, from which a note is due.
MOSTLY_FLOW, FEW_PLAYERS = 0.85, 14


def _rank(level: Column) -> Column:
    return F.when(level == "low", 0).when(level == "medium", 1).otherwise(2)


def _worst(*levels: Column) -> Column:
    least = F.least(*map(_rank, levels))
    return F.when(least == 0, "low").when(least == 1, "medium").otherwise("high")


def perception_quality(tracking: DataFrame, homographies: DataFrame, matches: DataFrame) -> DataFrame:
    """A row a match: overall level, a level for calibration, ball, tracks and teams, the numbers behind them, and notes.

    homographies: match_id, frame, h00, method, reproj_error_px. matches:
    match_id, source, fps, n_frames, team_separability, ball_observed_frames
    (null: estimated from confidence, as filled-in rows have at most half that
    of their neighbours). A source other than ``video:`` is exact, so all its
    levels are high. A signal that is not there is low.
    """
    valid = F.col("h00").isNotNull()
    direct = valid & ~F.col("method").isin("flow", "none")
    share = lambda c: F.avg(c.cast("double"))
    calibration = homographies.groupBy("match_id").agg(share(valid).alias("calibrated"), F.percentile(F.when(direct, F.col("reproj_error_px")), 0.5).alias("error_px"), F.avg(F.when(valid, (F.col("method") == "flow").cast("double"))).alias("flow"))
    balls = tracking.where("entity_id = -1")
    sure = balls.groupBy("match_id").agg((F.percentile("conf", 0.9) * 0.5).alias("sure"))
    frames = balls.join(sure, "match_id").groupBy("match_id", "frame").agg(F.max((F.col("conf") > F.col("sure")).cast("int")).alias("seen"))
    ball = frames.groupBy("match_id").agg(F.count("*").alias("ball_frames"), F.sum("seen").alias("sure_frames"))
    people = tracking.where("entity_id <> -1")
    lengths = people.groupBy("match_id", "entity_id").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.count("*").alias("n_tracks"), F.percentile("n", 0.5).alias("track_rows"))
    crowd = people.groupBy("match_id", "frame").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.percentile("n", 0.5).alias("players_median"))
    joined = matches
    for part in (calibration, ball, lengths, crowd):
        joined = joined.join(part, "match_id", "left")
    n = F.greatest(F.col("n_frames"), F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    numbers = joined.select(
        "match_id", F.coalesce(F.col("source").startswith("video:"), F.lit(False)).alias("is_video"), zero(F.col("calibrated")).alias("calibrated"), "error_px", zero(F.col("flow")).alias("flow_share"),
        zero(F.col("ball_frames") / n).alias("ball_share"), zero(F.coalesce(F.col("ball_observed_frames"), F.col("sure_frames")) / n).alias("ball_seen_share"), F.col("ball_observed_frames").isNull().alias("ball_is_estimated"),
        zero(F.col("players_median").cast("double")).alias("players_median"), F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), zero(F.when(F.col("fps") > 0, F.col("track_rows") / F.col("fps"))).alias("track_s_median"), "team_separability",
    )
    levels = {
        "calibration": _worst(grade(F.col("calibrated"), *CALIBRATED), grade(F.col("error_px"), *ERROR_PX, higher_is_better=False)), "ball": grade(F.col("ball_seen_share"), *BALL_SEEN),
        "tracks": grade(F.col("track_s_median"), *TRACK_S), "teams": grade(F.col("team_separability").cast("double"), *KITS),
    }
    graded = numbers.withColumns({f"{k}_level": F.when(F.col("is_video"), v).otherwise("high") for k, v in levels.items()})
    overall = _worst(*(F.col(f"{k}_level") for k in levels))
    due = [
        (~F.col("is_video"), F.lit("positions are exact")),
        (F.col("is_video") & (F.col("calibrated") < CALIBRATED[1]), F.format_string("calibrated in %.0f%% of frames", 100 * F.col("calibrated"))),
        (F.col("is_video") & (F.col("flow_share") > MOSTLY_FLOW) & (F.col("calibration_level") != "low"), F.lit("calibration is mostly propagated")),
        (F.col("is_video") & (F.col("ball_level") != "high"), F.format_string("ball observed in %.0f%% of frames", 100 * F.col("ball_seen_share"))),
        (F.col("is_video") & (F.col("tracks_level") == "low"), F.format_string("tracks last %.1f s", F.col("track_s_median"))),
        (F.col("is_video") & (F.col("players_median") < FEW_PLAYERS), F.format_string("%.0f players in view", F.col("players_median"))),
        (F.col("is_video") & (F.col("teams_level") == "low"), F.lit("kits are hard to tell apart")),
    ]
    notes = F.filter(F.array(*(F.when(c, t) for c, t in due)), lambda t: t.isNotNull())
    return graded.withColumns({"overall": overall, "notes": F.array_join(notes, "; ")})
