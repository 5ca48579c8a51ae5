"""Pass networks, line-breaking passes and expected threat."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, Threat
from ..functions.direction import directed, sign
from ..functions.pitch import attacking_x, attacking_y, cell
from .possession import players_only


def completed(events: DataFrame) -> DataFrame:
    return events.where("type = 'pass' and outcome = 'complete' and to_id >= 0")


def pass_edges(events: DataFrame) -> DataFrame:
    """(match_id, team, source, target, weight)."""
    return completed(events).groupBy("match_id", "team", F.col("from_id").alias("source"), F.col("to_id").alias("target")).agg(F.count("*").alias("weight"))


def pass_nodes(events: DataFrame) -> DataFrame:
    """(match_id, team, entity_id, x, y, volume): mean place of passing and receiving, and how many passes touch the player."""
    ends = F.array(F.struct(F.col("from_id").alias("entity_id"), "x", "y"), F.struct(F.col("to_id").alias("entity_id"), F.col("end_x").alias("x"), F.col("end_y").alias("y")))
    return completed(events).select("match_id", "team", F.explode(ends).alias("e")).groupBy("match_id", "team", "e.entity_id").agg(F.avg("e.x").alias("x"), F.avg("e.y").alias("y"), F.count("*").alias("volume"))


def pass_summary(edges: DataFrame) -> DataFrame:
    """(match_id, team, n_passes, n_players, density, top_source, top_target, top_weight): ties go to the lowest ids."""
    players = edges.select("match_id", "team", F.explode(F.array("source", "target")).alias("p")).groupBy("match_id", "team").agg(F.count_distinct("p").alias("n_players"))
    top = F.min(F.struct((-F.col("weight")).alias("w"), "source", "target"))
    sums = edges.groupBy("match_id", "team").agg(F.sum("weight").alias("n_passes"), F.count("*").alias("m"), top.alias("t"))
    n = F.col("n_players")
    return sums.join(players, ["match_id", "team"]).select("match_id", "team", "n_passes", "n_players", F.when(n > 1, F.col("m") / (n * (n - 1))).otherwise(0.0).alias("density"), F.col("t.source").alias("top_source"), F.col("t.target").alias("top_target"), (-F.col("t.w")).alias("top_weight"))


def centrality(nodes: list[int], links: list[tuple[int, int, float]], rounds: int = 500) -> dict[int, tuple[float, float]]:
    """Betweenness (shortest paths over 1/weight, normalised, directed) and eigenvector centrality (undirected) of a graph of a few nodes."""
    place = {v: i for i, v in enumerate(nodes)}
    n = len(nodes)
    cost = np.full((n, n), np.inf)
    both = np.zeros((n, n))
    for u, v, w in links:
        cost[place[u], place[v]] = 1 / w
        both[place[u], place[v]] = both[place[v], place[u]] = w
    between = np.zeros(n)
    for s in range(n):
        # distances settle one node at a time; paths are counted, then shares flow back
        far, paths, open_, order = np.full(n, np.inf), np.zeros(n), set(range(n)), []
        far[s], paths[s] = 0, 1
        while open_:
            v = min(open_, key=lambda k: (far[k], k))
            if np.isinf(far[v]):
                break
            open_.remove(v)
            order.append(v)
            for t in open_:
                d = far[v] + cost[v, t]
                if d < far[t] - 1e-12:
                    far[t], paths[t] = d, paths[v]
                elif np.isfinite(d) and abs(d - far[t]) <= 1e-12:
                    paths[t] += paths[v]
        share = np.zeros(n)
        for t in reversed(order):
            for v in order:
                if v != t and np.isfinite(cost[v, t]) and abs(far[v] + cost[v, t] - far[t]) <= 1e-12:
                    share[v] += paths[v] / paths[t] * (1 + share[t])
            if t != s:
                between[t] += share[t]
    if n > 2:
        between /= (n - 1) * (n - 2)
    x = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        y = both @ x + x
        y /= np.linalg.norm(y) or 1
        done = np.abs(y - x).sum() < n * 1e-6
        x = y
        if done:
            break
    else:
        x = np.zeros(n)
    return {v: (float(between[i]), float(x[i])) for v, i in place.items()}


def pass_centrality(edges: DataFrame) -> DataFrame:
    """(match_id, team, entity_id, betweenness, eigenvector): a graph has at most the players of a team, so each team is one small group."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        links = list(group.sort_values(["source", "target"])[["source", "target", "weight"]].itertuples(index=False, name=None))
        found = centrality(sorted({*group["source"], *group["target"]}), links)
        first = group.iloc[0]
        return pd.DataFrame([(first["match_id"], first["team"], v, b, e) for v, (b, e) in found.items()], columns=["match_id", "team", "entity_id", "betweenness", "eigenvector"])

    return edges.groupBy("match_id", "team").applyInPandas(work, f"match_id {dict(edges.dtypes)['match_id']}, team string, entity_id int, betweenness double, eigenvector double")


def most_central(central: DataFrame) -> DataFrame:
    """(match_id, team, entity_id, betweenness): the hub of each team's passes; ties, to nine decimals, go to the lowest id."""
    best = F.min(F.struct((-F.round("betweenness", 9)).alias("b"), "entity_id", "betweenness")).alias("m")
    return central.groupBy("match_id", "team").agg(best).select("match_id", "team", "m.entity_id", "m.betweenness")


def defensive_lines(tracking: DataFrame, passes: DataFrame, matches: DataFrame, tolerance: int = 3, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, team, from_id, line_x): mean depths of the defenders' lines at each pass, in the passing team's direction.

    Passes are spread over the frames around them, so that the defenders come
    by an equi-join. Lines part at the two widest gaps; a line has two players.
    Depths and gaps are compared to nine decimals; of equal gaps the one further
    forward parts, of equally deep players the smaller id stands behind.
    """
    key = ["match_id", "p_frame", "team", "from_id"]
    around = passes.select("match_id", F.col("frame").alias("p_frame"), "team", "from_id").distinct().withColumn("frame", F.explode(F.sequence(F.col("p_frame") - tolerance, F.col("p_frame") + tolerance)))
    others = players_only(tracking, goalkeepers=False).select("match_id", "frame", "entity_id", F.col("team").alias("d_team"), "x")
    mean = around.join(others, ["match_id", "frame"]).where("d_team <> team").groupBy(*key, "entity_id").agg(F.avg("x").alias("x"))
    placed = directed(mean, matches).withColumn("xa", F.round(attacking_x(F.col("x"), sign("team", "p_frame")), 9))
    group = Window.partitionBy(*key)
    order = group.orderBy("xa", "entity_id")
    gaps = placed.withColumns({"n": F.count("*").over(group), "gap": F.round(F.col("xa") - F.lag("xa").over(order), 9), "i": F.row_number().over(order)}).where("n >= 6")
    wide = F.row_number().over(group.orderBy(F.desc_nulls_last("gap"), F.desc("i"))) <= 2
    lines = gaps.withColumn("cut", wide.cast("int")).withColumn("line", F.sum("cut").over(order))
    return lines.groupBy(*key, "line").agg(F.avg("xa").alias("line_x"), F.count("*").alias("m")).where("m >= 2").select("match_id", F.col("p_frame").alias("frame"), "team", "from_id", "line_x")


def line_breaking(tracking: DataFrame, events: DataFrame, matches: DataFrame, margin: float = 2.0, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, frame, team, from_id, to_id, n_lines_broken): completed passes from behind a line to beyond it."""
    passes = events.where("type = 'pass' and outcome = 'complete'")
    s = sign()
    ends = directed(passes, matches).select("match_id", "frame", "team", "from_id", "to_id", attacking_x(F.col("x"), s).alias("x0"), attacking_x(F.col("end_x"), s).alias("x1"))
    lines = defensive_lines(tracking, passes, matches, cfg=cfg)
    broken = ends.join(lines, ["match_id", "frame", "team", "from_id"]).where((F.col("x0") < F.col("line_x") - margin) & (F.col("x1") > F.col("line_x") + margin))
    return broken.groupBy("match_id", "frame", "team", "from_id", "to_id").agg(F.count("*").alias("n_lines_broken"))


def moves(events: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, team, from_id, s, e): grid cells of completed passes and carries in the direction of attack."""
    t, p, s = cfg.threat, cfg.pitch, sign()

    def at(x: str, y: str):
        return cell(attacking_y(F.col(y), s), p.width, t.ny) * t.nx + cell(attacking_x(F.col(x), s), p.length, t.nx)

    return directed(events, matches).where("type in ('pass', 'carry') and outcome = 'complete'").select("match_id", "team", "from_id", at("x", "y").alias("s"), at("end_x", "end_y").alias("e"))


def xt_counts(found: DataFrame) -> DataFrame:
    """(match_id, s, e, n): moves between cells."""
    return found.groupBy("match_id", "s", "e").agg(F.count("*").alias("n"))


def value_grid(counts: np.ndarray, share_complete: float | None, t: Threat = DEFAULT.threat, length: float = 105.0, width: float = 68.0, shots: np.ndarray | None = None, goals: np.ndarray | None = None) -> np.ndarray:
    """Threat v of each cell, from v = shoots * scores + (1 - shoots) * complete * M v.

    M holds the chances of moving from cell to cell. Each chance is an estimate
    that mixes what was counted with a prior worth so many observations
    (``Threat``). The equation is linear, so it is solved and not iterated.
    """
    along, across = np.meshgrid((np.arange(t.nx) + 0.5) * length / t.nx, (np.arange(t.ny) + 0.5) * width / t.ny)
    place = along.ravel() + 1j * across.ravel()
    shots, goals = (np.zeros(len(place)) if v is None else v for v in (shots, goals))

    def estimate(hits, tries, chance, weight):
        return (hits + weight * chance) / (tries + weight)

    ahead = place.real[None, :] - place.real[:, None]
    likely = np.exp(np.clip(ahead, -t.forward_cut_m, t.forward_cut_m) / t.forward_m - abs(place[None, :] - place[:, None]) / t.reach_m)
    np.fill_diagonal(likely, 0)
    moving = estimate(counts, counts.sum(axis=1, keepdims=True), likely / likely.sum(axis=1, keepdims=True), t.move_weight)

    to_goal = abs(place - (length + 0.5j * width))
    shoots = estimate(shots, counts.sum(axis=1) + shots, t.shot_share * np.clip(t.shot_near - to_goal / t.shot_m, *t.shot_range), t.shot_weight)
    scores = estimate(goals, shots, np.clip(t.goal_near - to_goal / t.goal_m, *t.goal_range), t.goal_weight)
    complete = t.complete if share_complete is None else np.clip(share_complete, *t.complete_range)
    return np.linalg.solve(np.eye(len(place)) - ((1 - shoots) * complete)[:, None] * moving, shoots * scores)


def shot_counts(events: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, s, shots, goals) by grid cell in the direction of attack."""
    t, p, s = cfg.threat, cfg.pitch, sign()
    at = cell(attacking_y(F.col("y"), s), p.width, t.ny) * t.nx + cell(attacking_x(F.col("x"), s), p.length, t.nx)
    return directed(events.where("type = 'shot'"), matches).select("match_id", at.alias("s"), (F.col("outcome") == "goal").cast("int").alias("goal")).groupBy("match_id", "s").agg(F.count("*").alias("shots"), F.coalesce(F.sum("goal"), F.lit(0)).alias("goals"))


def stored_or_fitted(stored: DataFrame, fitted: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, cell, xt): a match's stored grid where it has a value for every cell, else the fitted one."""
    n = cfg.threat.nx * cfg.threat.ny
    whole = stored.where(F.col("xt").isNotNull() & F.col("cell").between(0, n - 1)).groupBy("match_id").agg(F.count_distinct("cell").alias("n")).where(F.col("n") == n).select("match_id")
    kept = stored.join(whole, "match_id", "left_semi").where(F.col("cell").between(0, n - 1)).groupBy("match_id", "cell").agg(F.min("xt").alias("xt"))
    return kept.unionByName(fitted.join(whole, "match_id", "left_anti").select("match_id", "cell", "xt"))


def xt_grids(events: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, cell, xt): one grid of each match, from its moves, shots and goals; matches are groups of at most 192 x 192 counts, so each is solved where it lies."""
    n = cfg.threat.nx * cfg.threat.ny
    tries = shot_counts(events, matches, cfg).select("match_id", "s", F.lit(-1).alias("e"), F.col("shots").alias("n"), "goals")
    counts = xt_counts(moves(events, matches, cfg)).withColumn("goals", F.lit(0)).unionByName(tries)
    passes = events.where("type = 'pass'").groupBy("match_id").agg(F.count("*").alias("passes"), F.avg((F.col("outcome") == "complete").cast("double")).alias("share"))
    rows = counts.join(passes, "match_id", "full")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        table, shots, goals = np.zeros((n, n)), np.zeros(n), np.zeros(n)
        known = group.dropna(subset=["s"])
        moved, tried = known[known["e"] >= 0], known[known["e"] < 0]
        table[moved["s"].astype(int), moved["e"].astype(int)] = moved["n"]
        shots[tried["s"].astype(int)], goals[tried["s"].astype(int)] = tried["n"], tried["goals"]
        first = group.iloc[0]
        grid = value_grid(table, first["share"] if first["passes"] >= 20 else None, cfg.threat, cfg.pitch.length, cfg.pitch.width, shots, goals)
        return pd.DataFrame({"match_id": first["match_id"], "cell": np.arange(n), "xt": grid})

    return rows.groupBy("match_id").applyInPandas(work, f"match_id {dict(events.dtypes)['match_id']}, cell int, xt double")


def player_xt(events: DataFrame, grids: DataFrame, matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(match_id, entity_id, team, xt_net, xt_created, n_moves)."""
    rows = moves(events, matches, cfg)
    at = lambda c, n: grids.select("match_id", F.col("cell").alias(c), F.col("xt").alias(n))
    gained = rows.join(at("s", "x0"), ["match_id", "s"]).join(at("e", "x1"), ["match_id", "e"]).withColumn("dxt", F.col("x1") - F.col("x0"))
    return gained.groupBy("match_id", F.col("from_id").alias("entity_id"), "team").agg(F.round(F.sum("dxt"), 4).alias("xt_net"), F.round(F.sum(F.greatest("dxt", F.lit(0.0))), 4).alias("xt_created"), F.count("*").alias("n_moves"))
