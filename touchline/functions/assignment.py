"""Small exact kernels on NumPy arrays: optimal assignment and convex hulls."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment of least total cost; a rectangular matrix assigns its shorter side.

    Shortest augmenting paths with dual prices: each row in turn finds the
    cheapest path to a free column.
    """
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        short, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        at, base, last = row, 0.0, -1
        while True:
            offer = base + cost[at] - price_row[at] - price_col
            better = ~done & (offer < short)
            short[better], came[better] = offer[better], last
            col = int(np.where(done, np.inf, short).argmin())
            done[col], base, last = True, short[col], col
            if owner[col] < 0:
                break
            at = owner[col]
        price_row[row] += base
        for c in np.flatnonzero(done):
            if c != last or owner[c] >= 0:
                if owner[c] >= 0:
                    price_row[owner[c]] += base - short[c]
                price_col[c] -= base - short[c]
        while last >= 0:
            before = came[last]
            owner[last] = owner[before] if before >= 0 else row
            last = before
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


def assign_many(cost: np.ndarray) -> np.ndarray:
    """(b, n): the column of each row, -1 for none, of b matrices of n rows; every one is assigned as by ``assign``, all at once."""
    cost = np.asarray(cost, float)
    b, n, m = cost.shape
    if n > m:
        rows, found = assign_many(cost.transpose(0, 2, 1)), np.full((b, n), -1)
        np.put_along_axis(found, rows, np.arange(m)[None], axis=1)
        return found
    price_row, price_col = np.zeros((b, n)), np.zeros((b, m))
    owner = np.full((b, m), -1)
    for row in range(n):
        short, came = np.full((b, m), np.inf), np.full((b, m), -1)
        done = np.zeros((b, m), bool)
        at, base, last = np.full(b, row), np.zeros(b), np.full(b, -1)
        open_ = np.arange(b)
        while len(open_):
            k = at[open_]
            offer = base[open_, None] + cost[open_, k] - price_row[open_, k][:, None] - price_col[open_]
            better = ~done[open_] & (offer < short[open_])
            short[open_] = np.where(better, offer, short[open_])
            came[open_] = np.where(better, last[open_, None], came[open_])
            col = np.where(done[open_], np.inf, short[open_]).argmin(axis=1)
            done[open_, col], base[open_], last[open_], at[open_] = True, short[open_, col], col, owner[open_, col]
            open_ = open_[owner[open_, col] >= 0]
        price_row[:, row] += base
        i, c = np.nonzero(done & (owner >= 0))
        rise = base[i] - short[i, c]
        price_row[i, owner[i, c]] += rise
        price_col[i, c] -= rise
        open_ = np.arange(b)
        while len(open_):
            c = last[open_]
            before = came[open_, c]
            owner[open_, c] = np.where(before >= 0, owner[open_, before], row)
            last[open_], open_ = before, open_[before >= 0]
    found = np.full((b, n), -1)
    i, c = np.nonzero(owner >= 0)
    found[i, owner[i, c]] = c
    return found


def outer(points: np.ndarray, ways: int = 32) -> np.ndarray:
    """The distinct points without those strictly inside the polygon of the farthest points in some directions, first in a few of them: all corners of the hull stay."""
    points = np.asarray(points, float)
    for n in (8, ways):
        if len(points) <= ways:
            break
        angles = 2 * np.pi * np.arange(n) / n
        far = (points @ np.stack([np.cos(angles), np.sin(angles)])).argmax(axis=0)
        ring = points[far[far != np.roll(far, 1)]]  # the last direction's point may be the first one's
        if len(ring) < 3:
            break
        x, y = points.T
        inside = np.ones(len(points), bool)
        for (px, py), (dx, dy) in zip(ring, np.roll(ring, -1, axis=0) - ring):
            inside &= dx * (y - py) - dy * (x - px) > 1e-9
        points = points[~inside]
    return np.unique(points, axis=0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order; the distinct points themselves if there are fewer than three."""
    unique = sorted(set(map(tuple, np.asarray(points, float))))
    if len(unique) < 3:
        return np.array(unique, float).reshape(-1, 2)

    def chain(ordered):
        kept = []
        for p in ordered:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(unique) + chain(unique[::-1]))


def hull_area(points: np.ndarray, fewest: int = 3) -> float:
    """Area of the convex hull; 0 for fewer points or points on a line."""
    ring = hull(points)
    if len(points) < fewest or len(ring) < 3:
        return 0.0
    x, y = ring.T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def matched(cost: np.ndarray, limit: float, strict: bool = False) -> list[tuple[int, int]]:
    """Pairs of the least total cost, where all pairs above ``limit`` (at it too, if ``strict``) cost the same and are left out.

    Rows and columns without a common pair below the limit are parts of their
    own, so that mostly single pairs are assigned.
    """
    cost = np.asarray(cost, float)
    open_ = cost < limit if strict else cost <= limit
    single = open_ & (open_.sum(axis=1, keepdims=True) == 1) & (open_.sum(axis=0, keepdims=True) == 1)
    found = list(zip(*(v.tolist() for v in np.nonzero(single))))
    left = set(np.flatnonzero(open_.any(axis=1)).tolist()) - {r for r, _ in found}
    while left:
        rows, cols, todo = set(), set(), [min(left)]
        while todo:
            r = todo.pop()
            if r in rows:
                continue
            rows.add(r)
            fresh = set(np.flatnonzero(open_[r]).tolist()) - cols
            cols |= fresh
            for c in fresh:
                todo += np.flatnonzero(open_[:, c]).tolist()
        left -= rows
        rs, cs = sorted(rows), sorted(cols)
        if len(rs) == 1:
            found.append((rs[0], cs[int(np.argmin(cost[rs[0], cs]))]))
            continue
        part = np.ix_(rs, cs)
        i, j = assign(np.where(open_[part], cost[part], limit if strict else limit + 1e5))
        found += [(rs[a], cs[b]) for a, b in zip(i, j) if open_[rs[a], cs[b]]]
    return sorted(found)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box (x1, y1, x2, y2) of one array with every box of another."""
    a, b = np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4)
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda boxes: np.clip(boxes[:, 2:] - boxes[:, :2], 0, None).prod(axis=1)
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def pairs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of a row of a and a row of b in the same group; both hold the rows' groups, numbers from 0, and b is in order."""
    counts = np.bincount(b, minlength=int(max(a.max(initial=0), b.max(initial=0))) + 1)
    width = counts[a]
    i = np.repeat(np.arange(len(a)), width)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + (np.cumsum(counts) - counts)[a][i]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of one array with the box of the other at its place, as ``overlaps`` has it."""
    both = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(axis=1)
    size = lambda v: np.clip(v[:, 2:] - v[:, :2], 0, None).prod(axis=1)
    union = size(a) + size(b) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def matched_many(i: np.ndarray, j: np.ndarray, cost: np.ndarray, limit: float, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) that ``matched`` finds among pairs (i, j) with these costs; pairs that are not given cost too much.

    Pairs that share nothing with another one below the limit are taken at once; parts that hang together are assigned with all others of their size.
    """
    open_ = np.flatnonzero(cost < limit if strict else cost <= limit)
    i, j, cost = i[open_], j[open_], cost[open_]
    if not len(i):
        return i, j
    single = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1)
    found = [(i[single], j[single])]
    i, j, cost = i[~single], j[~single], cost[~single]
    if len(i):
        rows, r = np.unique(i, return_inverse=True)
        cols, c = np.unique(j, return_inverse=True)
        part, before = np.arange(len(rows)), None
        while before is None or (part != before).any():  # the least row that hangs together with each
            before, of_col = part.copy(), np.full(len(cols), len(rows))
            np.minimum.at(of_col, c, part[r])
            np.minimum.at(part, r, of_col[c])
        _, part = np.unique(part, return_inverse=True)
        of_col[c] = part[r]
        sizes = np.stack([np.bincount(part), np.bincount(of_col)], axis=1)
        by_part = [np.argsort(v, kind="stable") for v in (part, of_col)]
        starts = np.cumsum(sizes, axis=0) - sizes
        places = [np.empty(len(v), int) for v in by_part]
        for side, v in enumerate((part, of_col)):
            places[side][by_part[side]] = np.arange(len(v)) - starts[v[by_part[side]], side]
        for n, k in np.unique(sizes, axis=0).tolist():
            same = np.flatnonzero((sizes == (n, k)).all(axis=1))
            number = np.full(len(sizes), -1)
            number[same] = np.arange(len(same))
            at = np.flatnonzero(number[part[r]] >= 0)
            costs, known = np.full((len(same), n, k), limit if strict else limit + 1e5), np.zeros((len(same), n, k), bool)
            cell = (number[part[r[at]]], places[0][r[at]], places[1][c[at]])
            costs[cell], known[cell] = cost[at], True
            taken = np.where(known, costs, np.inf).argmin(axis=2) if n == 1 else assign_many(costs)
            p, q = np.nonzero((taken >= 0) & np.take_along_axis(known, np.maximum(taken, 0)[:, :, None], axis=2)[:, :, 0])
            found.append((rows[by_part[0][starts[same[p], 0] + q]], cols[by_part[1][starts[same[p], 1] + taken[p, q]]]))
    i, j = (np.concatenate(v) for v in zip(*found))
    return i, j
