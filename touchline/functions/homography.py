"""Homographies from pixels to the pitch: fits by the direct linear transform, and whether one can be believed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pitch import project


def apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points (..., n, 2) through homographies (..., 3, 3); not a number for points at infinity."""
    moved = np.concatenate([points, np.ones((*points.shape[:-1], 1))], axis=-1) @ np.swapaxes(h, -1, -2)
    w = np.where(np.abs(moved[..., 2:]) < 1e-12, np.nan, moved[..., 2:])
    return moved[..., :2] / w


def _centred(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points about their mean at a mean distance of sqrt 2, the matrices that do that, whether they are apart)."""
    mean = points.mean(axis=1, keepdims=True)
    far = np.linalg.norm(points - mean, axis=2).mean(axis=1)
    apart = far >= 1e-9
    s = np.sqrt(2) / np.where(apart, far, 1.0)
    t = np.zeros((len(points), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    t[:, :2, 2] = -s[:, None] * mean[:, 0]
    t[:, 2, 2] = 1
    return (points - mean) * s[:, None, None], t, apart


def fit(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(homographies (k, 3, 3), whether each is sound) of k sets of n >= 4 matched points (k, n, 2): exact for four, least squares for more.

    Not sound, and not a number, are sets whose points coincide or lie on a line.
    """
    k, n = source.shape[:2]
    if n < 4:
        return np.full((k, 3, 3), np.nan), np.zeros(k, bool)
    a, ta, ok_a = _centred(source)
    b, tb, ok_b = _centred(target)
    one = np.concatenate([a, np.ones((k, n, 1))], axis=2)
    rows = np.zeros((k, n, 2, 9))
    rows[:, :, 0, 0:3], rows[:, :, 1, 3:6] = -one, -one
    rows[:, :, 0, 6:9], rows[:, :, 1, 6:9] = b[:, :, :1] * one, b[:, :, 1:] * one
    _, sizes, basis = np.linalg.svd(rows.reshape(k, 2 * n, 9), full_matrices=True)
    h = np.linalg.inv(tb) @ basis[:, -1].reshape(k, 3, 3) @ ta
    # eight singular values belong to the eight unknowns
    sound = ok_a & ok_b & (sizes[:, 7] >= 1e-10) & (np.abs(h[:, 2, 2]) >= 1e-12)
    h = np.where(sound[:, None, None], h / np.where(sound, h[:, 2, 2], 1.0)[:, None, None], np.nan)
    return h, sound


def rms(h: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Root of the mean squared distance of the mapped points from their targets."""
    return np.sqrt(np.nanmean(((apply(h, source) - target) ** 2).sum(axis=2), axis=1))


def plausible(h: list[Column], width: float, height: float, pitch_length: float = 105.0, pitch_width: float = 68.0) -> Column:
    """Whether an image of this size maps to a convex patch of a believable area, with a believable scale: fixed bounds of 150 square metres to four pitches, and of 0.25 to 60 metres for 100 pixels, 25-fold at most."""
    corners = [project(h, F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (width, 0.0), (width, height), (0.0, height))]
    turns, area = [], F.lit(0.0)
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = corners[i], corners[(i + 1) % 4], corners[(i + 2) % 4]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
        area = area + ax * by - ay * bx
    area = F.abs(area) / 2
    spans = []
    for fx in (0.25, 0.5, 0.75):
        for fy in (0.35, 0.65):
            (ax, ay), (bx, by) = (project(h, F.lit(width * fx + d), F.lit(height * fy)) for d in (0.0, 100.0))
            spans.append(F.hypot(bx - ax, by - ay))
    known = F.lit(True)
    for value in [v for c in corners for v in c] + spans:
        known = known & value.isNotNull() & ~F.isnan(value)
    convex = (F.least(*turns) > 0) | (F.greatest(*turns) < 0)
    small, large = F.least(*spans), F.greatest(*spans)
    fine = area.between(150.0, 4.0 * pitch_length * pitch_width) & convex & (small >= 0.25) & (large <= 60.0) & (large <= 25.0 * F.greatest(small, F.lit(1e-9)))
    return F.coalesce(known & fine, F.lit(False))
