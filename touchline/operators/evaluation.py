"""How good tracks and events are against the truth: CLEAR-MOT, identities, and events matched one to one in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assignment import matched, matched_many, overlaps, pairs_of, shared
from ..functions.folds import fold, fold_together
from ..functions.sequences import ordered

#: Fixed value: what a match of the frame before is worth in overlap.
STEADY = 0.2


def foot_boxes(points: DataFrame, width: float = 12.0, height: float = 24.0) -> DataFrame:
    """(match_id, frame, track_id, x1, y1, x2, y2) of fixed boxes that stand on foot pixels (x_pixel, y_pixel), so that overlap stands for distance; rows without pixels go."""
    x, y = F.col("x_pixel"), F.col("y_pixel")
    return points.where("x_pixel is not null and y_pixel is not null").select("match_id", "frame", F.col("entity_id").alias("track_id"), (x - width / 2).alias("x1"), (y - height).alias("y1"), (x + width / 2).alias("x2"), y.alias("y2"))


def match_step(least: float):
    """Pairs of one frame's true and found boxes of the greatest total overlap, that of the last match counting more; of these, pairs that overlap enough."""

    def step(last: dict, match, frame: int, rows: list[dict]) -> list[tuple]:
        true, found = [r for r in rows if r["true"]], [r for r in rows if not r["true"]]
        if not true or not found:
            return []
        box = lambda r: [r["x1"], r["y1"], r["x2"], r["y2"]]
        both = overlaps(np.array([box(r) for r in true]), np.array([box(r) for r in found]))
        cost = 1 - both
        places = {r["track_id"]: j for j, r in enumerate(found)}
        for i, r in enumerate(true):
            j = places.get(last.get(r["track_id"]))
            if j is not None and both[i, j] >= least:
                cost[i, j] -= STEADY
        out = []
        for i, j in matched(cost, 1.0, strict=True):
            if both[i, j] >= least:
                a, b = true[i]["track_id"], found[j]["track_id"]
                out.append((match, frame, a, b, a in last and last[a] != b))
                last[a] = b
        return out

    return step


class Last:
    """For the matches of a task: the last found box of each true one, by match number and id in one number, in order."""

    def __init__(self):
        self.matches, self.keys, self.found = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key has a last box, its key)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.found[at]

    def keep(self, keys: np.ndarray, found: np.ndarray) -> None:
        """Sets the last boxes of keys, of equal ones the later."""
        keys, first = np.unique(np.concatenate([keys[::-1], self.keys]), return_index=True)
        self.found, self.keys = np.concatenate([found[::-1], self.found])[first], keys


def matches_step(least: float):
    """``match_step`` for one frame of several matches; gives the same pairs."""
    none = -(2**31)  # stands for a missing id

    def step(last: Last, frame: int, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        coded = batch.column("match_id").dictionary_encode()
        m = np.array([last.matches.setdefault(v, len(last.matches)) for v in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        true = batch.column("true").to_numpy(zero_copy_only=False).astype(bool)
        ids, box = batch.column("track_id").fill_null(none).to_numpy().astype(np.int64), np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1)
        key = (m << 32) + ids
        own, other = (np.flatnonzero(side)[np.argsort(m[side], kind="stable")] for side in (true, ~true))
        i, j = pairs_of(m[own], m[other])
        a, b = box[own], box[other]
        if least > 0:  # boxes that do not meet cost 1
            near = np.flatnonzero((a[:, 0][i] < b[:, 2][j]) & (b[:, 0][j] < a[:, 2][i]))
            i, j = i[near], j[near]
        both = shared(a[i], b[j])
        known, before = last.known(key[own])
        # of found boxes with one id the last one counts
        order = np.argsort(key[other], kind="stable")
        later = np.ones(len(other), bool)
        later[order[:-1]] = np.diff(key[other][order]) != 0
        steady = known[i] & (before[i] == key[other][j]) & later[j] & (both >= least)
        r, c = matched_many(i, j, (1 - both) - np.where(steady, STEADY, 0.0), 1.0, strict=True)
        sure = shared(a[r], b[c]) >= least
        at = np.argsort(r[sure], kind="stable")
        r, c = r[sure][at], c[sure][at]
        if not len(r):
            return None
        of, to = key[own[r]], key[other[c]]
        switched = known[r] & (before[r] != to)
        order = np.argsort(of, kind="stable")
        again = order[1:][np.diff(of[order]) == 0]  # a true id that the frame has twice goes by the one before
        switched[again] = to[again] != to[order[:-1][np.diff(of[order]) == 0]]
        last.keep(of, to)
        cell = lambda v: pa.array(v, pa.int32(), mask=v == none)
        cells = [batch.column("match_id").take(pa.array(own[r])), pa.array(np.full(len(r), frame), pa.int32()), cell(ids[own[r]]), cell(ids[other[c]]), pa.array(switched)]
        return pa.RecordBatch.from_arrays(cells, names=["match_id", "frame", "true_id", "track_id", "switched"])

    return step


def matched_boxes(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(match_id, frame, true_id, track_id, switched) of the boxes that belong together; rows of both tables have match_id, frame, track_id, x1, y1, x2, y2. Frames of many matches are one step."""
    columns = ["match_id", "frame", "track_id", "x1", "y1", "x2", "y2"]
    rows = truth.select(*columns, F.lit(True).alias("true")).unionByName(found.select(*columns, F.lit(False).alias("true")))
    rows = rows.withColumns({"frame": F.col("frame").cast("int"), "track_id": F.col("track_id").cast("int")})
    return fold_together(rows, Last, matches_step(least), f"match_id {dict(rows.dtypes)['match_id']}, frame int, true_id int, track_id int, switched boolean")


def tracking_metrics(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(match_id, mota, idf1, id_switches, false_positives, false_negatives, matches, true_boxes, found_boxes).

    Boxes meet frame by frame. For identities, the pairs of ids that occur
    together most often overall are matched one to one: that table has a row a
    pair of ids that ever met, and its unconnected parts are matched each on
    its own.
    """
    pairs = matched_boxes(truth, found, least)
    if pairs.sparkSession.sparkContext.getCheckpointDir():
        pairs = pairs.checkpoint()
    kind = dict(pairs.dtypes)["match_id"]
    met = pairs.groupBy("match_id", "true_id", "track_id").agg(F.count("*").alias("n"))

    def together(group: pd.DataFrame) -> pd.DataFrame:
        true, ids = sorted(set(group["true_id"])), sorted(set(group["track_id"]))
        table = np.zeros((len(true), len(ids)))
        at, to = {v: i for i, v in enumerate(true)}, {v: i for i, v in enumerate(ids)}
        table[group["true_id"].map(at), group["track_id"].map(to)] = group["n"]
        return pd.DataFrame({"match_id": group["match_id"][:1], "idtp": [int(sum(table[i, j] for i, j in matched(-table, 0.0, strict=True)))]})

    same = met.groupBy("match_id").applyInPandas(together, f"match_id {kind}, idtp long")
    sums = pairs.groupBy("match_id").agg(F.count("*").alias("matches"), F.sum(F.col("switched").cast("int")).alias("id_switches"))
    counts = [d.groupBy("match_id").agg(F.count("*").alias(n)) for d, n in ((truth, "true_boxes"), (found, "found_boxes"))]
    joined = counts[0].join(counts[1], "match_id", "full").join(sums, "match_id", "left").join(same, "match_id", "left").fillna(0)
    lost, false = F.col("true_boxes") - F.col("matches"), F.col("found_boxes") - F.col("matches")
    mota = 1 - (lost + false + F.col("id_switches")) / F.greatest(F.col("true_boxes"), F.lit(1))
    idf1 = 2.0 * F.col("idtp") / F.greatest(F.col("true_boxes") + F.col("found_boxes"), F.lit(1))
    return joined.select("match_id", F.round(mota, 4).alias("mota"), F.round(idf1, 4).alias("idf1"), "id_switches", false.alias("false_positives"), lost.alias("false_negatives"), "matches", "true_boxes", "found_boxes")


def _free_step(within: int):
    """Takes for each derived event the first true one that is near and not yet taken; true events are held while a derived one may still want them."""

    def step(state: dict, match, frame: int, rows: list[dict]) -> list[tuple]:
        out = []
        for r in sorted(rows, key=lambda r: (r["at"], r["n"])):
            if r["true"]:
                state.setdefault("free", []).append((r["at"], r["n"]))
            else:
                state.setdefault("asking", []).append((r["at"], r["n"]))
        # a derived event is decided once no true one can come that is near it
        asking, free = state.get("asking", []), state.get("free", [])
        while asking and asking[0][0] + within <= frame:
            at, n = asking.pop(0)
            while free and free[0][0] <= at - within:
                free.pop(0)
            if free and free[0][0] < at + within:
                t, m = free.pop(0)
                out.append((match, at, n, t, m))
        return out

    return step


def matched_events(derived: DataFrame, truth: DataFrame, within: int = 40) -> DataFrame:
    """(match_id, frame, n, true_frame, true_n): each derived event's first true event less than ``within`` frames away that no earlier one has taken, in order of frame and number.

    Both tables have match_id, frame and n, a number that parts events of a
    frame. The fold keeps true events of two windows at most.
    """
    columns = lambda d, true: d.select("match_id", F.col("frame").cast("int").alias("at"), F.col("n").cast("int").alias("n"), F.lit(true).alias("true"))
    both = columns(derived, False).unionByName(columns(truth, True)).withColumn("frame", F.col("at"))
    # a last frame that decides what is still open
    ends = both.groupBy("match_id").agg((F.max("at") + within).alias("frame")).select("match_id", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("boolean").alias("true"), "frame")
    kind = dict(derived.dtypes)["match_id"]

    def step(state, match, frame, rows):
        return _free_step(within)(state, match, frame, [r for r in rows if r["true"] is not None])

    return fold(both.unionByName(ends), dict, step, f"match_id {kind}, frame int, n int, true_frame int, true_n int")


def event_agreement(derived: DataFrame, truth: DataFrame, within: int = 40) -> DataFrame:
    """(match_id, n_derived, n_true, n_matched, precision, recall, f1) of events matched one to one."""
    parts = [d.groupBy("match_id").agg(F.count("*").alias(n)) for d, n in ((derived, "n_derived"), (truth, "n_true"), (matched_events(derived, truth, within), "n_matched"))]
    joined = parts[0].join(parts[1], "match_id", "full").join(parts[2], "match_id", "left").fillna(0)
    p, r = F.col("n_matched") / F.greatest("n_derived", F.lit(1)), F.col("n_matched") / F.greatest("n_true", F.lit(1))
    return joined.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def radius_sweep(tracking: DataFrame, truth: DataFrame, possession, events, radii: tuple, within: int, configs) -> DataFrame:
    """(radius_m, match_id, ...) of event_agreement for several radii of possession: how sure passes and how many of them."""
    found = None
    for radius in radii:
        cfg = configs(radius)
        held = possession(tracking, cfg)
        passes = numbered(events(tracking, held, cfg).where("type = 'pass'"))
        row = event_agreement(passes, truth, within).select(F.lit(float(radius)).alias("radius_m"), "*")
        found = row if found is None else found.unionByName(row)
    return found


def numbered(events: DataFrame) -> DataFrame:
    """Events with a number within their match and frame."""
    order = ordered("match_id", "frame", by="from_id")
    return events.withColumn("n", F.row_number().over(order))


def owner_agreement(held: DataFrame, truth: DataFrame) -> DataFrame:
    """(match_id, n_frames, agreement): the share of true frames (match_id, frame, team) whose team in possession is the one found; a frame not found has none."""
    both = truth.select("match_id", "frame", F.col("team").alias("true_team")).join(held.select("match_id", "frame", "team"), ["match_id", "frame"], "left")
    same = (F.coalesce("team", F.lit("none")) == F.col("true_team")).cast("double")
    return both.groupBy("match_id").agg(F.count("*").alias("n_frames"), F.avg(same).alias("agreement"))


def labels_flipped(found: DataFrame, truth: DataFrame, every: int = 25) -> DataFrame:
    """(match_id, n_same, n_flipped, flipped): whether home stands for the true away, by each found player's nearest true player in every ``every``-th frame; ties go to the smaller id."""
    sides = F.col("team").isin("home", "away")
    rows = found.where(sides & (F.col("frame") % every == 0)).where("x is not null and y is not null")
    true = truth.where(F.col("class").isin("player", "goalkeeper") & (F.col("frame") % every == 0)).select("match_id", "frame", F.col("entity_id").alias("true_id"), F.col("team").alias("true_team"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = rows.join(true, ["match_id", "frame"]).groupBy("match_id", "frame", "entity_id", "team").agg(F.min(F.struct(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")).alias("d"), "true_id", "true_team")).alias("t"))
    votes = near.where(F.col("t.true_team").isin("home", "away"))
    n = lambda c: F.sum(c.cast("int"))
    counted = votes.groupBy("match_id").agg(n(F.col("team") == F.col("t.true_team")).alias("n_same"), n(F.col("team") != F.col("t.true_team")).alias("n_flipped"))
    return counted.withColumn("flipped", F.col("n_flipped") > F.col("n_same"))
