"""Pitch control, off-screen ghosts and Voronoi areas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.sequences import ordered


def ghosts(kin: DataFrame, horizon_s: float = 1.0, tau: float = 1.5, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, frame, x, y, vx, vy, ghost): the rows and, after each, up to the horizon of drifted ones until the entity is seen again or its match ends."""
    horizon = int(horizon_s * cfg.fps)
    # the match's end is a window over rows that lie by match already, so that the motion is computed once
    rows = kin.select("match_id", "entity_id", "frame", "x", "y", "vx", "vy").withColumn("next", F.lead("frame").over(ordered("match_id", "entity_id"))).withColumn("last", F.max("frame").over(Window.partitionBy("match_id")))
    until = F.least(F.coalesce(F.col("next") - 1, F.col("last")), F.col("frame") + horizon)
    spread = rows.withColumn("f", F.explode(F.sequence("frame", until)))
    t = (F.col("f") - F.col("frame")) / cfg.fps
    fade = F.exp(-t / tau)
    drift = tau * (1 - fade)
    return spread.select("match_id", "entity_id", F.col("f").alias("frame"), (F.col("x") + F.col("vx") * drift).alias("x"), (F.col("y") + F.col("vy") * drift).alias("y"), (F.col("vx") * fade).alias("vx"), (F.col("vy") * fade).alias("vy"), (F.col("f") > F.col("frame")).alias("ghost"))


def every_nth_frame(kin: DataFrame, every: int = 12) -> DataFrame:
    """The rows of every n-th distinct frame of a match."""
    nth = F.dense_rank().over(Window.partitionBy("match_id").orderBy("frame")) - 1
    return kin.withColumn("_nth", nth).where(F.col("_nth") % every == 0).drop("_nth")


def control_surface(home: np.ndarray, away: np.ndarray, cfg: Config = DEFAULT) -> np.ndarray:
    """(frames, ny, nx): the probability that the home team reaches a cell first, from the projected places (frames, players, 2) of either team, missing ones being NaN."""
    c, p = cfg.control, cfg.pitch
    cx, cy = (np.arange(c.nx) + 0.5) * (p.length / c.nx), (np.arange(c.ny) + 0.5) * (p.width / c.ny)

    def soonest(team: np.ndarray) -> np.ndarray:
        best = np.full((len(team), c.ny, c.nx), np.inf)
        for k in range(team.shape[1]):
            dx, dy = team[:, k, 0, None] - cx, team[:, k, 1, None] - cy
            best = np.fmin(best, np.sqrt(dx[:, None, :] ** 2 + dy[:, :, None] ** 2))
        return best / c.speed_mps

    with np.errstate(invalid="ignore", over="ignore"):
        odds = 1 / (1 + np.exp((soonest(home) - soonest(away)) / c.sigma_s))
    both = np.isfinite(home[:, :, 0]).any(axis=1) & np.isfinite(away[:, :, 0]).any(axis=1) if home.shape[1] and away.shape[1] else np.zeros(len(home), bool)
    return np.where(both[:, None, None], odds, 0.5)


def _frames(moving: DataFrame, fewest: int, cfg: Config) -> DataFrame:
    """(match_id, frame, home, away): a frame of enough players as one row, its teams' projected places as flat arrays."""
    c = cfg.control
    reach = F.array(F.col("x") + c.reaction_s * F.col("vx"), F.col("y") + c.reaction_s * F.col("vy"))
    sides = (F.flatten(F.collect_list(F.when(F.col("team") == t, reach))).alias(t) for t in ("home", "away"))
    return moving.groupBy("match_id", "frame").agg(*sides).where(F.size("home") + F.size("away") >= 2 * fewest)


def _places(column: pa.Array) -> np.ndarray:
    """Flat lists of x and y as (frames, most players, 2), filled up with NaN."""
    sizes = np.diff(np.asarray(column.offsets)) // 2
    flat = np.asarray(column.flatten(), float).reshape(-1, 2)
    out = np.full((len(sizes), int(sizes.max(initial=0)), 2), np.nan)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _surfaces(batch: pa.RecordBatch, cfg: Config, most: int = 256):
    """(first frame, end frame, surfaces) of a batch of ``_frames``, some frames at a time."""
    home, away = _places(batch.column("home")), _places(batch.column("away"))
    for start in range(0, batch.num_rows, most):
        yield start, min(start + most, batch.num_rows), control_surface(home[start : start + most], away[start : start + most], cfg)


def control_frames(moving: DataFrame, fewest: int = 6, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, home_control, right_third, left_third) of rows (match_id, frame, team, x, y, vx, vy): means over all cells and over the outer 17 and 18 columns, in frames of six players or more."""
    nx = cfg.control.nx

    def work(batches):
        for batch in batches:
            for a, b, found in _surfaces(batch, cfg):
                means = (found.mean(axis=(1, 2)), found[:, :, nx - nx // 3 :].mean(axis=(1, 2)), found[:, :, : -(-nx // 3)].mean(axis=(1, 2)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("match_id", "frame")] + [pa.array(m) for m in means], names=["match_id", "frame", "home_control", "right_third", "left_third"])

    kinds = dict(moving.dtypes)
    return _frames(moving, fewest, cfg).mapInArrow(work, f"match_id {kinds['match_id']}, frame {kinds['frame']}, home_control double, right_third double, left_third double")


def mean_control(moving: DataFrame, fewest: int = 6, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, iy, ix, home): the mean surface; a batch of frames sends on one sum for each of its matches."""
    nx, ny = cfg.control.nx, cfg.control.ny

    def work(batches):
        for batch in batches:
            match = batch.column("match_id").to_pylist()
            sums: dict = {}
            for a, b, found in _surfaces(batch, cfg):
                for key in dict.fromkeys(match[a:b]):
                    own = np.array([m == key for m in match[a:b]])
                    total, n = sums.get(key, (0.0, 0))
                    sums[key] = (total + found[own].sum(axis=0), n + int(own.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch.schema.field("match_id").type), pa.array([n for _, n in sums.values()], pa.int64()), pa.array([t.ravel() for t, _ in sums.values()], pa.list_(pa.float64()))], names=["match_id", "n", "total"])

    parts = _frames(moving, fewest, cfg).mapInArrow(work, f"match_id {dict(moving.dtypes)['match_id']}, n bigint, total array<double>")
    cells = parts.select("match_id", "n", F.posexplode("total").alias("cell", "v")).groupBy("match_id", "cell").agg((F.sum("v") / F.sum("n")).alias("home"))
    return cells.select("match_id", F.floor(F.col("cell") / nx).cast("int").alias("iy"), (F.col("cell") % nx).alias("ix"), "home")


def clipped_area(points: np.ndarray, own: int, length: float, width: float) -> float:
    """Area of the pitch nearer to one point than to the others: the rectangle cut by a half-plane for each of them.

    The nearest come first; one whose half-plane lies beyond all corners ends the cuts.
    """
    px, py = points[own].tolist()
    others = sorted(((ox - px) ** 2 + (oy - py) ** 2, ox - px, oy - py) for ox, oy in points.tolist())
    shape = [(-px, -py), (length - px, -py), (length - px, width - py), (-px, width - py)]
    for square, nx, ny in others:
        if square == 0:  # the point itself or one in the same place
            continue
        if not shape or square > 4 * max(x * x + y * y for x, y in shape):
            break
        kept = []
        ax, ay = shape[-1]
        sa = ax * nx + ay * ny - square / 2
        for bx, by in shape:
            sb = bx * nx + by * ny - square / 2
            if (sa < 0 < sb) or (sb < 0 < sa):
                t = sa / (sa - sb)
                kept.append((ax + (bx - ax) * t, ay + (by - ay) * t))
            if sb <= 0:
                kept.append((bx, by))
            ax, ay, sa = bx, by, sb
        shape = kept
    if len(shape) < 3:
        return 0.0
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(shape, shape[1:] + shape[:1]))) / 2


def clipped_areas(points: np.ndarray, length: float, width: float) -> np.ndarray:
    """(frames, players) ``clipped_area`` of all points (frames, players, 2) at once, missing ones being NaN: all cells are cut by their next nearest point until it is too far to matter."""
    frames, players, _ = points.shape
    away = points[:, None] - points[:, :, None]
    square = np.nan_to_num((away**2).sum(axis=3), nan=np.inf)
    order = square.argsort(axis=2, kind="stable")
    away = np.take_along_axis(away, order[..., None], axis=2).reshape(-1, players, 2)
    square = np.take_along_axis(square, order, axis=2).reshape(-1, players)
    areas = np.zeros(frames * players)
    cell = np.flatnonzero(np.isfinite(points).all(axis=2).ravel())
    own = points.reshape(-1, 2)[cell]
    # corners of the cells that are still cut, cell after cell, around their points
    x = np.stack([-own[:, 0], length - own[:, 0], length - own[:, 0], -own[:, 0]], axis=1).ravel()
    y = np.stack([-own[:, 1], -own[:, 1], width - own[:, 1], width - own[:, 1]], axis=1).ravel()
    n = np.full(len(cell), 4)
    for k in range(players + 1):
        if not len(cell):
            break
        starts = np.cumsum(n) - n
        before = np.arange(len(x)) - 1
        before[starts] = starts + n - 1
        over = square[cell, k] > 4 * np.maximum.reduceat(x * x + y * y, starts) if k < players else np.ones(len(cell), bool)
        if over.any():
            areas[cell[over]] = abs(np.add.reduceat(x[before] * y - x * y[before], starts)[over]) / 2
            keep = np.repeat(~over, n)
            x, y, cell, n = x[keep], y[keep], cell[~over], n[~over]
            if not len(cell):
                break
            starts = np.cumsum(n) - n
            before = np.arange(len(x)) - 1
            before[starts] = starts + n - 1
        at = np.repeat(cell, n)
        s = x * away[at, k, 0] + y * away[at, k, 1] - square[at, k] / 2
        sa, ax, ay = s[before], x[before], y[before]
        crossed = ((sa < 0) & (s > 0)) | ((s < 0) & (sa > 0))
        t = np.divide(sa, sa - s, out=np.zeros_like(s), where=crossed)
        made = np.stack([crossed, s <= 0], axis=1)
        n = np.add.reduceat(made.sum(axis=1), starts)
        x, y = (np.stack([a + (b - a) * t, b], axis=1)[made] for a, b in ((ax, x), (ay, y)))
        cell, n = cell[n > 0], n[n > 0]
    return areas.reshape(frames, players)


def voronoi_areas(rows: DataFrame, cfg: Config = DEFAULT, most: int = 512) -> DataFrame:
    """(match_id, frame, home_area, away_area) of rows (match_id, frame, team, x, y): null with fewer than four players. A frame is one row of flat arrays."""
    p = cfg.pitch
    place = F.array(F.col("x"), F.col("y"))
    frames = rows.groupBy("match_id", "frame").agg(*(F.flatten(F.sort_array(F.collect_list(F.when(F.col("team") == t, place)))).alias(t) for t in ("home", "away")))

    def work(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                home, away = _places(batch.column("home")), _places(batch.column("away"))
                areas = clipped_areas(np.concatenate([home, away], axis=1), p.length, p.width)
                few = np.diff(np.asarray(batch.column("home").offsets)) + np.diff(np.asarray(batch.column("away").offsets)) < 8
                sides = (areas[:, : home.shape[1]].sum(axis=1), areas[:, home.shape[1] :].sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("match_id"), batch.column("frame"), *(pa.array(v, pa.float64(), mask=few) for v in sides)], names=["match_id", "frame", "home_area", "away_area"])

    kinds = dict(rows.dtypes)
    return frames.mapInArrow(work, f"match_id {kinds['match_id']}, frame {kinds['frame']}, home_area double, away_area double")
