"""Tables of perception: votes, gaps, ball cleaning, projection, quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.pitch import contains, grade, project
from ..functions.sequences import islands, ordered


def without_fragments(rows: DataFrame, fewest: int) -> DataFrame:
    """Rows of entities with enough of them; the ball always stays."""
    n = F.count("*").over(Window.partitionBy("match_id", "entity_id"))
    return rows.withColumn("_n", n).where((F.col("_n") >= fewest) | (F.col("entity_id") == -1)).drop("_n")


def class_votes(rows: DataFrame) -> DataFrame:
    """(match_id, entity_id, class): the class with the largest sum of confidence, the first by name on ties."""
    sums = rows.groupBy("match_id", "entity_id", "class").agg(F.round(F.sum("conf"), 6).alias("s"))
    return sums.groupBy("match_id", "entity_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "class")).alias("m")).select("match_id", "entity_id", "m.class")


def jersey_votes(readings: DataFrame, least: float = 0.55, fewest: int = 2, share: float = 0.6) -> DataFrame:
    """(match_id, entity_id, number, weight_share, n): numbers that enough sure readings agree on."""
    sure = readings.where(F.col("conf") >= least).groupBy("match_id", "entity_id", "number").agg(F.sum("conf").alias("w"), F.count("*").alias("n"))
    group = Window.partitionBy("match_id", "entity_id")
    best = sure.withColumns({"part": F.col("w") / F.sum("w").over(group), "r": F.row_number().over(group.orderBy(F.desc(F.round("w", 6)), "number"))})
    return best.where((F.col("r") == 1) & (F.col("n") >= fewest) & (F.col("part") >= share)).select("match_id", "entity_id", "number", F.col("part").alias("weight_share"), "n")


def attack_direction(rows: DataFrame, *parts: str) -> DataFrame:
    """(match_id, parts, home_sign): the team that stands further left on average, in each part of the match, attacks to the right."""
    means = rows.groupBy("match_id", *parts).agg(*(F.avg(F.when(F.col("team") == t, F.col("x"))).alias(t) for t in ("home", "away")))
    return means.select("match_id", *parts, F.when(F.col("home") <= F.col("away"), 1).otherwise(-1).alias("home_sign"))


def bridged(rows: DataFrame, longest: int = 25) -> DataFrame:
    """(match_id, entity_id, frame, x, y, conf, filled): gaps of 2 to ``longest`` frames filled in linearly, less sure the further from both ends."""
    key = ["match_id", "entity_id"]
    nexts = rows.withColumns({f"n_{c}": F.lead(c).over(ordered(*key)) for c in ("frame", "x", "y", "conf")})
    gap = F.col("n_frame") - F.col("frame")
    until = F.when(gap.between(2, longest), F.col("n_frame") - 1).otherwise(F.col("frame"))
    spread = nexts.withColumns({"gap": gap, "f": F.explode(F.sequence("frame", until))})
    t = (F.col("f") - F.col("frame")) / F.col("gap")
    inner = F.col("f") > F.col("frame")
    mix = lambda c: F.when(inner, F.col(c) + (F.col(f"n_{c}") - F.col(c)) * t).otherwise(F.col(c)).alias(c)
    taper = 1 - F.least(t, 1 - t) * 2
    sure = F.when(inner, F.least("conf", "n_conf") * 0.5 * (0.5 + 0.5 * taper)).otherwise(F.col("conf"))
    return spread.select(*key, F.col("f").alias("frame"), mix("x"), mix("y"), sure.alias("conf"), inner.alias("filled"))


def without_jumps(ball: DataFrame, longest: int = 12, floor_px: float = 40.0, factor: float = 8.0) -> DataFrame:
    """(match_id, frame, x, y) of rows near the median of five around them, in segments parted by long gaps or cuts (column ``cut``)."""
    order = ordered("match_id")
    parts = islands(ball, ((F.col("frame") - F.lag("frame").over(order)) > longest) | F.col("cut"), "segment", "match_id")
    around = ordered("match_id", "segment").rowsBetween(-2, 2)
    off = parts.withColumns({"mx": F.percentile("x", 0.5).over(around), "my": F.percentile("y", 0.5).over(around)}).withColumn("r", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    typical = off.groupBy("match_id", "segment").agg(F.percentile("r", 0.5).alias("t"))
    joined = off.join(typical, ["match_id", "segment"])
    return joined.where(F.col("r") <= F.greatest(F.lit(floor_px), factor * F.col("t"))).select("match_id", "frame", "x", "y")


def reprojected(pixels: DataFrame, homographies: DataFrame, margin: float = 6.0) -> DataFrame:
    """Rows with x and y from their pixels by the frame's homography; null off the pitch; rows of frames without one keep what they have."""
    names = [f"h{i}{j}" for i in range(3) for j in range(3)]
    joined = pixels.join(homographies.select("match_id", "frame", *names), ["match_id", "frame"], "left")
    x, y = project([F.col(n) for n in names], F.col("x_pixel"), F.col("y_pixel"))
    known, inside = F.col("h00").isNotNull(), contains(x, y, margin)
    return joined.withColumns({"x": F.when(~known, F.col("x")).when(inside, x), "y": F.when(~known, F.col("y")).when(inside, y)}).drop(*names)


def quality(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, n_frames, ball_coverage, players_median, conf_median, n_tracks, track_rows_median, ball_level, level): how far a match's table can be trusted; the level is its worst part's."""
    people = F.col("entity_id") != -1
    frames = rows.groupBy("match_id", "frame").agg(F.sum(people.cast("int")).alias("players"), F.max((~people).cast("int")).alias("ball"))
    by_frame = frames.groupBy("match_id").agg(F.count("*").alias("n_frames"), F.avg(F.col("ball").cast("double")).alias("ball_coverage"), F.percentile("players", 0.5).alias("players_median"))
    tracks = rows.where(people).groupBy("match_id", "entity_id").agg(F.count("*").alias("n"))
    by_track = tracks.groupBy("match_id").agg(F.count("*").alias("n_tracks"), F.percentile("n", 0.5).alias("track_rows_median"))
    conf = rows.groupBy("match_id").agg(F.percentile("conf", 0.5).alias("conf_median"))
    joined = by_frame.join(by_track, "match_id").join(conf, "match_id")
    levels = {"ball_level": grade(F.col("ball_coverage"), 0.8, 0.5), "_players": grade(F.col("players_median"), 18.0, 12.0), "_conf": grade(F.col("conf_median"), 0.7, 0.4)}
    rank = lambda c: F.when(F.col(c) == "low", 0).when(F.col(c) == "medium", 1).otherwise(2)
    worst = F.least(rank("ball_level"), rank("_players"), rank("_conf"))
    return joined.withColumns(levels).withColumn("level", F.when(worst == 0, "low").when(worst == 1, "medium").otherwise("high")).drop("_players", "_conf")


def nearest_vectors(vectors: DataFrame, asking: DataFrame, k: int = 5, block: int = 512) -> DataFrame:
    """(vec_id, neighbour_id, cosine, place): the k nearest of ``vectors`` (vec_id, embedding) by cosine for each row of ``asking``; null and zero vectors have no neighbours.

    Both sides are dealt into blocks, blocks of queries meet blocks of vectors,
    and only each pair's best k leave the task that multiplies them.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("embedding is not null and vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = max(1, -(-rows.count() // block))
        return rows.withColumn(f"{name}_block", F.pmod(F.xxhash64("vec_id"), F.lit(n))).groupBy(f"{name}_block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias(name))

    def unit(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        ids, found = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
        size = np.linalg.norm(found, axis=1)
        return ids[size > 1e-9], (found[size > 1e-9].T / size[size > 1e-9]).T

    def work(batches):
        for batch in batches:
            for left, right in zip(batch.column("q"), batch.column("v")):
                (qi, q), (vi, v) = unit(left.as_py()), unit(right.as_py())
                found: list[tuple] = []
                if len(qi) and len(vi):
                    near = np.round(q @ v.T, 9)
                    near[qi[:, None] == vi[None, :]] = -2
                    for i, row in enumerate(near):
                        top = np.lexsort((vi, -row))[:k]
                        found += [(int(qi[i]), int(vi[j]), float(row[j])) for j in top if row[j] > -2]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["vec_id", "neighbour_id", "cosine"])

    met = blocks(asking, "q").crossJoin(blocks(vectors, "v")).repartition("q_block", "v_block").select("q", "v")
    best = met.mapInArrow(work, "vec_id bigint, neighbour_id bigint, cosine double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)
