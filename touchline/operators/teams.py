"""Teams from the looks of tracks: two clusters of signatures, and who belongs to neither."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clusters import kmeans

#: Distances from the own centre, in medians of it and in gaps of both centres, beyond which a track belongs to no team; a separability below the last is poor; the ends of the pitch where goalkeepers stand.
OUTLIER_MEDIANS, OUTLIER_GAPS, POOR, END = 2.5, 0.6, 1.5, 0.18


def track_signatures(samples: DataFrame) -> DataFrame:
    """(match_id, track_id, n, signature): the median of each track's samples (signature array), number by number."""
    numbers = samples.select("match_id", "track_id", F.posexplode("signature").alias("i", "v"))
    medians = numbers.groupBy("match_id", "track_id", "i").agg(F.percentile("v", 0.5).alias("v"), F.count("*").alias("n"))
    return medians.groupBy("match_id", "track_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("signature"))


def split(signatures: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(cluster of each, how far the clusters are apart in medians of the distance to the own one, whether each is an outlier); every number is scaled first, so that none decides alone."""
    x = (signatures - signatures.mean(axis=0)) / (signatures.std(axis=0) + 1e-6)
    own, centres = kmeans(x, 2)
    far = np.linalg.norm(x - centres[own], axis=1)
    inner, gap = float(np.median(far) + 1e-6), float(np.linalg.norm(centres[0] - centres[1]))
    return own, gap / inner, far > max(OUTLIER_MEDIANS * inner, OUTLIER_GAPS * gap)


def assigned_teams(tracks: DataFrame, length: float = 105.0) -> DataFrame:
    """(match_id, track_id, team, class, separability, poor) of tracks (match_id, track_id, class, mean_x, signature).

    Outfield tracks are two clusters; the one of the smallest track id is home.
    Where no class is known but player, outliers are goalkeepers at the ends of
    the pitch and referees elsewhere (and where mean_x is null). A goalkeeper
    belongs to the team that stands on its side on average. With fewer than
    four outfield tracks nobody has a team. A match has some hundred tracks.
    """
    kind = dict(tracks.dtypes)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("track_id").reset_index(drop=True)
        classes, x = group["class"].to_list(), group["mean_x"].to_numpy(float)
        team, apart = np.full(len(group), "none", object), np.nan
        field = [i for i, c in enumerate(classes) if c not in ("referee", "goalkeeper")]
        keepers = [i for i, c in enumerate(classes) if c == "goalkeeper"]
        if len(field) >= 4:
            own, apart, out = split(np.stack([np.asarray(v, float) for v in group["signature"].iloc[field]]))
            known = len(field) < len(group)
            for i, c, o in zip(field, own, out):
                if o and not known:
                    at_end = x[i] < END * length or x[i] > (1 - END) * length
                    classes[i] = "goalkeeper" if at_end else "referee"
                    keepers += [i] if at_end else []
                else:
                    team[i] = "home" if c == 0 else "away"
            means = [np.nanmean(x[team == t]) if np.isfinite(x[team == t]).any() else np.nan for t in ("home", "away")]
            for i in keepers:
                if np.isfinite(means).all() and np.isfinite(x[i]):
                    home_left = means[0] <= means[1]
                    team[i] = "home" if (x[i] < length / 2) == home_left else "away"
        return pd.DataFrame({"match_id": group["match_id"], "track_id": group["track_id"], "team": team, "class": classes, "separability": apart, "poor": bool(apart < POOR)})

    return tracks.groupBy("match_id").applyInPandas(work, f"match_id {kind['match_id']}, track_id {kind['track_id']}, team string, class string, separability double, poor boolean")
