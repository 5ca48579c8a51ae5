"""Homographies of frames from matched points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.homography import fit, plausible, rms


def fitted_homographies(points: DataFrame, width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """(match_id, frame, n_points, homography, rms_m, sound, plausible) of matched points (match_id, frame, u, v, x, y): null and not sound for fewer than four, coincident or collinear ones.

    A frame's points are one row, and the frames of a batch with equally many
    points are solved at once.
    """
    kind = dict(points.dtypes)["match_id"]
    frames = points.where("u is not null and v is not null and x is not null and y is not null").groupBy("match_id", "frame").agg(F.sort_array(F.collect_list(F.struct("u", "v", "x", "y"))).alias("points"))

    def work(batches):
        for batch in batches:
            listed = [np.array([(p["u"], p["v"], p["x"], p["y"]) for p in row], float) for row in batch.column("points").to_pylist()]
            counts = np.array([len(p) for p in listed])
            flat, error, sound = [None] * len(listed), [None] * len(listed), [False] * len(listed)
            for n in np.unique(counts).tolist():
                at = np.flatnonzero(counts == n)
                stack = np.stack([listed[i] for i in at])
                h, ok = fit(stack[:, :, :2], stack[:, :, 2:])
                far = rms(h, stack[:, :, :2], stack[:, :, 2:]) if n >= 4 and ok.any() else np.zeros(len(at))
                for k, i in enumerate(at.tolist()):
                    if ok[k]:
                        flat[i], error[i], sound[i] = h[k].ravel().tolist(), float(far[k]), True
            yield pa.RecordBatch.from_arrays([batch.column("match_id"), batch.column("frame"), pa.array(counts, pa.int32()), pa.array(flat, pa.list_(pa.float64())), pa.array(error, pa.float64()), pa.array(sound)], names=["match_id", "frame", "n_points", "homography", "rms_m", "sound"])

    found = frames.mapInArrow(work, f"match_id {kind}, frame int, n_points int, homography array<double>, rms_m double, sound boolean")
    return found.withColumn("plausible", F.col("sound") & plausible([F.get("homography", F.lit(i)) for i in range(9)], width, height))
