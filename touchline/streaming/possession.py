"""Possession and ball windows over live frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .live import live


def possession_step(cfg: Config = DEFAULT):
    """One frame of (entity_id, dist_m) of the nearest player: who holds the ball, in three numbers of state."""
    radius, need = cfg.possession.radius_m, cfg.possession.hysteresis_rows

    def step(state: dict, match, frame: int, rows: list[dict]) -> list[tuple]:
        row = min(rows, key=lambda r: (r["dist_m"], r["entity_id"]))
        now = int(row["entity_id"]) if row["dist_m"] <= radius else -1
        state["run"] = state.get("run", 0) + 1 if now == state.get("candidate", -1) else 1
        state["candidate"] = now
        if now != -1 and (state.get("holder", -1) == -1 or state["run"] == need):
            state["holder"] = now
        return [(match, frame, state.get("holder", -1))]

    return step


def live_possession(candidates: DataFrame, cfg: Config = DEFAULT, idle_ms: int = 600_000) -> DataFrame:
    """(match_id, frame, holder_id) of a stream (match_id, frame, entity_id, dist_m) of nearest players, in order of frame; a match's state goes ``idle_ms`` after its last row."""
    kind = dict(candidates.dtypes)["match_id"]
    return live(candidates, dict, possession_step(cfg), f"match_id {kind}, frame int, holder_id int", idle_ms)


def live_shares(held: DataFrame, seconds: int = 20, late: str = "10 seconds") -> DataFrame:
    """(match_id, window, team, n): rows by team in tumbling windows of a stream (match_id, at timestamp, team), rows later than the watermark left out."""
    return held.withWatermark("at", late).groupBy("match_id", F.window("at", f"{seconds} seconds").alias("window"), "team").agg(F.count("*").alias("n"))
