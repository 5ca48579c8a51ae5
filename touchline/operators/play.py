"""Events derived from possession: passes, carries, turnovers, counter-attacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.direction import directed, sign
from ..functions.pitch import attacking_x, distance
from ..functions.sequences import islands, last_known, next_known, ordered
from .possession import ball_of, players_only


def nearest_ball(tracking: DataFrame) -> DataFrame:
    """(match_id, frame, ball_frame, ball_x, ball_y) of every frame: the ball where it was seen last or is seen next, whichever is nearer, and the earlier one of two."""
    ball = ball_of(tracking).select("match_id", "frame", F.struct(F.col("frame").alias("at"), "ball_x", "ball_y").alias("ball"))
    frames = tracking.select("match_id", "frame").distinct().join(ball, ["match_id", "frame"], "left")
    sides = frames.withColumns({"last": last_known(F.col("ball"), "match_id"), "next": next_known(F.col("ball"), "match_id")})
    later = F.col("last").isNull() | (F.col("next.at") - F.col("frame") < F.col("frame") - F.col("last.at"))
    near = sides.withColumn("near", F.when(later & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("last"))).where("near is not null")
    return near.select("match_id", "frame", F.col("near.at").alias("ball_frame"), "near.ball_x", "near.ball_y")


def held_rows(tracking: DataFrame, held: DataFrame) -> DataFrame:
    """All frames inside spells, with the spell's number, the ball of the nearest frame that has one (the earlier of two), and its distance to the holder (infinite where the holder isn't seen).

    A frame without a ball has no row of possession, so it belongs to the spell
    of the rows on either side. Both lookups are windows over a row a frame,
    and players' rows meet these by a hash of the frames, unsorted.
    """
    runs = islands(held, F.lag("holder_id").over(ordered("match_id")) != F.col("holder_id"), "spell", "match_id")
    where = players_only(tracking).select("match_id", "frame", F.col("entity_id").alias("holder_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    own = runs.select("match_id", "frame", F.struct("spell", "holder_id", "team").alias("own"))
    frames = nearest_ball(tracking).join(own, ["match_id", "frame"], "left")
    before, after = last_known(F.col("own"), "match_id"), next_known(F.col("own"), "match_id")
    inside = frames.withColumns({"before": before, "after": after}).where("before.spell = after.spell and before.holder_id <> -1").select("match_id", "frame", "before.*", "ball_x", "ball_y")
    joined = inside.hint("shuffle_hash").join(where, ["match_id", "frame", "holder_id"], "left")
    return joined.withColumn("d", F.coalesce(distance("ball_x", "ball_y", "px", "py"), F.lit(float("inf"))))


def events(tracking: DataFrame, held: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, type, team, from_id, to_id, x, y, end_x, end_y, outcome) from each spell and the one after it.

    A spell is released at its last frame, and received at its first frame,
    with the ball near the holder. The last spell of a match gives nothing.
    """
    near = F.col("d") <= cfg.possession.radius_m
    at = F.struct("frame", "ball_x", "ball_y")
    spells = held_rows(tracking, held).groupBy("match_id", "spell", "holder_id").agg(
        F.min_by("team", "frame").alias("team"),
        F.coalesce(F.max(F.when(near, at)), F.max(at)).alias("out"),
        F.coalesce(F.min(F.when(near, at)), F.min(at)).alias("into"),
    )
    after = ordered("match_id", by="spell")
    pairs = spells.withColumns({f"n_{c}": F.lead(c).over(after) for c in ("holder_id", "team", "into")}).where("n_holder_id is not null")
    o, i, n = (lambda c: F.col(f"out.{c}")), (lambda c: F.col(f"into.{c}")), (lambda c: F.col(f"n_into.{c}"))
    moved = distance(o("ball_x"), o("ball_y"), n("ball_x"), n("ball_y"))
    carried = distance(i("ball_x"), i("ball_y"), o("ball_x"), o("ball_y"))
    soon = (n("frame") - o("frame")) / cfg.fps <= cfg.events.gap_s
    far = moved >= cfg.events.pass_m
    same = F.col("n_team") == F.col("team")
    nan = F.lit(None).cast("double")
    no_one = F.lit(-1)

    def event(when, frame, kind, team, to, x, y, ex, ey, outcome):
        named = dict(frame=frame, type=F.lit(kind), team=team, from_id=F.col("holder_id"), to_id=to, x=x, y=y, end_x=ex, end_y=ey, outcome=outcome)
        return F.when(when, F.struct(*(v.alias(k) for k, v in named.items())))

    ob, nb, ib = (o("ball_x"), o("ball_y")), (n("ball_x"), n("ball_y")), (i("ball_x"), i("ball_y"))
    found = F.array(
        event(carried >= cfg.events.carry_m, i("frame"), "carry", F.col("team"), F.col("holder_id"), *ib, *ob, F.lit("complete")),
        event(soon & same & (F.col("n_holder_id") != F.col("holder_id")) & far, o("frame"), "pass", F.col("team"), F.col("n_holder_id"), *ob, *nb, F.lit("complete")),
        event(soon & ~same, n("frame"), "turnover", F.col("n_team"), F.col("n_holder_id"), *nb, nan, nan, F.when(far, "interception").otherwise("tackle")),
        event(soon & ~same & far, o("frame"), "pass", F.col("team"), no_one, *ob, *nb, F.lit("intercepted")),
    )
    return pairs.select("match_id", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("match_id", "e.*")


def event_counts(found: DataFrame) -> DataFrame:
    """(match_id, team, passes, completed, turnovers, carries)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return found.groupBy("match_id", "team").agg(
        n(F.col("type") == "pass").alias("passes"),
        n((F.col("type") == "pass") & (F.col("outcome") == "complete")).alias("completed"),
        n(F.col("type") == "turnover").alias("turnovers"),
        n(F.col("type") == "carry").alias("carries"),
    )


def counter_attacks(found: DataFrame, ball: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, team, gain_m, duration_s, speed_mps): turnovers after which the ball gains ground fast.

    The range join goes by buckets of the window's length, so that a turnover
    meets the ball rows of two buckets and no more.
    """
    span = int(cfg.events.counter_window_s * cfg.fps)
    won = found.where("type = 'turnover'").select("match_id", F.col("frame").alias("f0"), "team", F.explode(F.array(F.floor(F.col("frame") / span), F.floor(F.col("frame") / span) + 1)).alias("bucket"))
    rows = ball.withColumn("bucket", F.floor(F.col("frame") / span))
    seen = won.hint("shuffle_hash").join(rows, ["match_id", "bucket"]).where(F.col("frame").between(F.col("f0"), F.col("f0") + span))
    forward = directed(seen, matches).withColumn("xa", attacking_x(F.col("ball_x"), sign()))
    runs = forward.groupBy("match_id", "f0", "team").agg(F.count("*").alias("n"), F.min_by("xa", "frame").alias("first"), F.max("xa").alias("best"), F.max(F.struct("xa", -F.col("frame")))["col2"].alias("neg_frame"))
    gain = F.col("best") - F.col("first")
    duration = (-F.col("neg_frame") - F.col("f0")) / cfg.fps
    return runs.where((F.col("n") >= cfg.events.counter_rows) & (gain >= cfg.events.counter_gain_m)).select("match_id", F.col("f0").alias("frame"), "team", gain.alias("gain_m"), duration.alias("duration_s"), (gain / F.greatest(duration, F.lit(0.4))).alias("speed_mps"))
