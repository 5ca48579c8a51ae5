"""Kinematics, movement profiles and where players are."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.pitch import cell, third
from ..functions.sequences import islands, ordered
from .possession import players_only


def minutes_played(tracking: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, team, minutes): team is the most frequent, the least on ties."""
    rows = tracking.where("class in ('player', 'goalkeeper')")
    return rows.groupBy("match_id", "entity_id").agg(F.mode("team", deterministic=True).alias("team"), (F.count_distinct("frame") / cfg.fps / 60).alias("minutes"))


def resampled(tracking: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, frame, x, y, seen): the observations, and between those that no long gap parts every frame, filled in linearly; ``seen`` tells observations from filled rows."""
    key = ["match_id", "entity_id"]
    rows = players_only(tracking).where("frame is not null").select(*key, "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    nexts = rows.withColumns({f"n_{c}": F.lead(c).over(ordered(*key)) for c in ("frame", "x", "y")})
    bridged = F.col("n_frame") - F.col("frame") <= cfg.kinematics.gap_frames
    filled = nexts.withColumn("f", F.explode(F.sequence("frame", F.when(bridged, F.greatest(F.col("n_frame") - 1, F.col("frame"))).otherwise(F.col("frame")))))
    share = F.coalesce((F.col("f") - F.col("frame")) / F.nullif(F.col("n_frame") - F.col("frame"), F.lit(0)), F.lit(0.0))
    mix = lambda c: F.col(c) + F.when(bridged, F.col(f"n_{c}") - F.col(c)).otherwise(0.0) * share
    return filled.select(*key, F.col("f").alias("frame"), mix("x").alias("x"), mix("y").alias("y"), (F.col("f") == F.col("frame")).alias("seen"))


def _runs(rows: pa.Table, cfg: Config) -> tuple[np.ndarray, ...]:
    """Frame, run, place in the run (from 0), the run's size, x and y of an entity's rows in order; runs of fewer observations than the smoothing window are left out."""
    frame, seen, x, y = (rows.column(c).to_numpy() for c in ("frame", "seen", "x", "y"))
    order = np.argsort(frame, kind="stable")
    frame, seen, x, y = (v[order] for v in (frame, seen, x, y))
    run = np.cumsum(np.concatenate([[True], np.diff(frame) > cfg.kinematics.gap_frames]))
    kept = (np.bincount(run, weights=seen) >= cfg.kinematics.window(cfg.fps))[run]
    frame, run, x, y = (v[kept] for v in (frame, run, x, y))
    start = np.flatnonzero(np.diff(run, prepend=0))
    size = np.diff(np.append(start, len(run)))
    return frame, run, np.arange(len(run)) - np.repeat(start, size), np.repeat(size, size), x, y


def _quadratics(v: np.ndarray, i: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The values smoothed by local quadratics over n rows.

    Inside a run the quadratic's centre is a weighted sum over the window; the
    first and last half windows take the quadratic of the run's first and last
    full window at their own place.
    """
    half = n // 2
    s2 = sum(k * k for k in range(-half, half + 1))
    s4 = sum(k**4 for k in range(-half, half + 1))
    det = n * s4 - s2 * s2
    padded, totals = np.pad(v, half), []
    for power in range(3):
        total = np.zeros(len(v))
        for k in range(-half, half + 1):
            if k or not power:
                near = padded[half + k : half + k + len(v)]
                total += k**power * near if power else near
        totals.append(total)
    t = i - np.clip(i, half, size - half - 1)
    m0, m1, m2 = (total[np.arange(len(v)) - t] for total in totals)
    return (s4 * m0 - s2 * m2) / det + m1 / s2 * t + (n * m2 - s2 * m0) / det * t * t


def _by_entity(rows: DataFrame, work, columns: str, cfg: Config) -> DataFrame:
    """(match_id, entity_id and the columns) that ``work`` finds in the runs of each entity of a match."""
    kinds = dict(rows.dtypes)

    def one(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = work(*_runs(group, cfg))
        n = len(next(iter(found.values())))
        return pa.table({"match_id": pa.repeat(key[0], n), "entity_id": pa.repeat(key[1], n), **found})

    return rows.groupBy("match_id", "entity_id").applyInArrow(one, f"match_id {kinds['match_id']}, entity_id {kinds['entity_id']}, {columns}")


def smoothed(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, run, frame, x, y) of ``resampled`` rows, smoothed by local quadratics; an entity of a match is one group of numbers."""
    n, kind = cfg.kinematics.window(cfg.fps), dict(rows.dtypes)["frame"]

    def work(frame, run, i, size, x, y):
        return {"run": run, "frame": frame, "x": _quadratics(x, i, size, n), "y": _quadratics(y, i, size, n)}

    return _by_entity(rows, work, f"run long, frame {kind}, x double, y double", cfg)


def _marks(vx: np.ndarray, vy: np.ndarray, speed: np.ndarray, cfg: Config) -> dict[str, np.ndarray]:
    """1 where a run of fast rows of an entity reaches a sprint's length, and where its heading changes while it moves; rows are in order, a speed over the cap is not a number."""
    k, at = cfg.kinematics, np.arange(len(speed))
    with np.errstate(invalid="ignore"):
        fast, moves = speed >= k.sprint_mps, speed > k.turn_mps
    began = np.maximum.accumulate(np.where(np.append(True, fast[1:] != fast[:-1])[: len(at)], at, 0)) if len(at) else at
    turned = np.abs(np.diff(np.arctan2(vy, vx), prepend=np.nan))
    turned = np.degrees(np.where(turned > math.pi, 2 * math.pi - turned, turned))
    return {"sprint": (fast & (at - began + 1 == max(1, int(k.sprint_s * cfg.fps)))).astype(np.int32), "turn": (moves & (turned > k.turn_deg)).astype(np.int32)}


def kinematics(tracking: DataFrame, cfg: Config = DEFAULT, marks: bool = False) -> DataFrame:
    """(match_id, entity_id, run, frame, x, y, vx, vy, speed, accel): central differences inside a run, one-sided at its ends; a speed over the cap is null, and counts as 0 in accel. With ``marks`` also sprint and turn, which ``movement_profiles`` counts: an entity's rows are in order here, so it need not sort them again."""
    rows = resampled(tracking, cfg)
    n, kind = cfg.kinematics.window(cfg.fps), dict(rows.dtypes)["frame"]

    def work(frame, run, i, size, x, y):
        x, y = (_quadratics(v, i, size, n) for v in (x, y))

        def slope(v: np.ndarray) -> np.ndarray:
            before, after = np.roll(v, 1), np.roll(v, -1)
            return np.where(i == 0, after - v, np.where(i == size - 1, v - before, (after - before) / 2)) * cfg.fps

        vx, vy = slope(x), slope(y)
        raw = np.sqrt(vx * vx + vy * vy)
        capped = raw <= cfg.kinematics.cap_mps
        found = {"run": run, "frame": frame, "x": x, "y": y, "vx": vx, "vy": vy, "speed": pa.array(raw, mask=~capped), "accel": slope(np.where(capped, raw, 0.0))}
        return found | _marks(vx, vy, np.where(capped, raw, np.nan), cfg) if marks else found

    return _by_entity(rows, work, f"run long, frame {kind}, x double, y double, vx double, vy double, speed double, accel double{', sprint int, turn int' if marks else ''}", cfg)


def movement_profiles(kin: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, minutes, distance_m, top_speed, mean_speed, hi_distance_m, n_sprints, accel_p90, n_turns).

    A sprint counts once, when a run of fast rows of one entity reaches its
    length; turns are changes of heading while moving.
    """
    k, key = cfg.kinematics, ["match_id", "entity_id"]
    marked = kin
    if "sprint" not in kin.columns:
        fast = F.coalesce(F.col("speed") >= k.sprint_mps, F.lit(False))
        order = ordered(*key)
        runs = islands(kin.withColumn("fast", fast), F.lag("fast").over(order) != F.col("fast"), "bout", *key)
        in_bout = F.row_number().over(ordered(*key, "bout"))
        heading = F.atan2("vy", "vx")
        turned = F.abs(heading - F.lag(heading).over(order))
        wrapped = F.when(turned > math.pi, 2 * math.pi - turned).otherwise(turned)
        marked = runs.withColumns({"sprint": (F.col("fast") & (in_bout == max(1, int(k.sprint_s * cfg.fps)))).cast("int"), "turn": (F.coalesce(F.degrees(wrapped) > k.turn_deg, F.lit(False)) & F.coalesce(F.col("speed") > k.turn_mps, F.lit(False))).cast("int")})
    return marked.groupBy(*key).agg(
        (F.count("*") / cfg.fps / 60).alias("minutes"),
        (F.sum("speed") / cfg.fps).alias("distance_m"),
        F.max("speed").alias("top_speed"),
        F.avg("speed").alias("mean_speed"),
        (F.coalesce(F.sum(F.when(F.col("speed") >= k.high_mps, F.col("speed"))), F.lit(0.0)) / cfg.fps).alias("hi_distance_m"),
        F.sum("sprint").alias("n_sprints"),
        F.percentile(F.abs("accel"), 0.9).alias("accel_p90"),
        F.sum("turn").alias("n_turns"),
    )


def third_occupation(tracking: DataFrame) -> DataFrame:
    """(match_id, team, third, share) over raw thirds; an empty third has share 0."""
    rows = players_only(tracking).withColumn("third", third(F.col("x")))
    counted = rows.groupBy("match_id", "team").agg(*(F.avg((F.col("third") == i).cast("double")).alias(f"s{i}") for i in range(3)))
    return counted.select("match_id", "team", F.posexplode(F.array("s0", "s1", "s2")).alias("third", "share"))


def heatmaps(tracking: DataFrame, nx: int = 52, ny: int = 34, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, entity_id, iy, ix, n): counts by team (entity_id null) and by player in one scan; positions off the pitch are left out."""
    p = cfg.pitch
    rows = players_only(tracking).where(F.col("x").between(0, p.length) & F.col("y").between(0, p.width))
    binned = rows.select("match_id", "team", "entity_id", cell(F.col("y"), p.width, ny).alias("iy"), cell(F.col("x"), p.length, nx).alias("ix"))
    cols = ["match_id", "team", "entity_id", "iy", "ix"]
    return binned.groupingSets([["match_id", "team", "iy", "ix"], cols], *cols).agg(F.count("*").alias("n"))


def blurred(grid: DataFrame, value: str, *keys: str, sigma: float = 1.5, nx: int = 52, ny: int = 34) -> DataFrame:
    """(keys, iy, ix, v): the grid under a Gaussian with reflected edges, cut at four sigmas, and scaled to sum 1.

    Two passes over a small table of kernel weights, one for each axis.
    """
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-radius, radius + 1), raw)))

    def along(df: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        # every value goes to the cells whose window, reflected, covers it
        spread = df.select(*keys, other, F.col(axis).alias("at"), "v", F.explode(weights).alias("kw"))
        to = F.col("at") + F.col("kw.k")
        inside = spread.select(*keys, other, to.alias(axis), (F.col("v") * F.col("kw.w")).alias("v"))
        folded = F.when(F.col(axis) < 0, -F.col(axis) - 1).when(F.col(axis) >= size, 2 * size - 1 - F.col(axis)).otherwise(F.col(axis))
        return inside.withColumn(axis, folded.cast("int")).groupBy(*keys, axis, other).agg(F.sum("v").alias("v"))

    start = grid.select(*keys, "iy", "ix", F.col(value).cast("double").alias("v"))
    both = along(along(start, "iy", "ix", ny), "ix", "iy", nx)
    total = both.groupBy(*keys).agg(F.sum("v").alias("total"))
    return both.join(total, list(keys)).select(*keys, "iy", "ix", (F.col("v") / F.col("total")).alias("v"))
