"""Suffix sorting by linear grouping: suffixes are grouped by their Lyndon prefixes, then each group's order is emitted.

Groups hold suffixes with the same prefix, at first their first symbol. They
are processed in descending order. Each suffix of a group gets the pointer to
the next smaller suffix on its left: the last one before it that no group
processed so far holds, found along the pointers already set. Those pointed to
have this group's prefix as the next part of their own, as many times as
suffixes point to them, so they leave their group for a new one right above
it. In the end each group is one Lyndon prefix, and one pass over the suffixes
in ascending order puts each one's left neighbour, and along the pointers those
it ends, at the next place of its group. No names are assigned again and no
part of the input is sorted twice.
"""

from __future__ import annotations

import numpy as np


def grouped(symbols: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """(group of each suffix, pointer to the previous smaller suffix or -1, groups in ascending order as (name, members))."""
    n = len(symbols)
    kinds, first = np.unique(symbols, return_inverse=True)
    by_kind = np.argsort(first, kind="stable")
    ends = np.cumsum(np.bincount(first, minlength=len(kinds)))
    members = [part.tolist() for part in np.split(by_kind, ends[:-1])]
    group = first.tolist()
    below, above = list(range(-1, len(kinds) - 1)), list(range(1, len(kinds) + 1))
    above[-1] = -1
    smaller, done = [-1] * n, bytearray(n)
    now, order = len(kinds) - 1, []
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        order.append(now)
        for i in own:
            done[i] = 1
        counts: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, c in counts.items():  # ascending, as pointers never cross
                by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
            for c in sorted(by_count, reverse=True):
                for old, moved in by_count[c].items():
                    new = len(members)
                    members.append(moved)
                    upper = above[old]
                    below.append(old)
                    above.append(upper)
                    below[upper] = new
                    above[old] = new
                    for j in moved:
                        group[j] = new
        now = below[now]
    return group, smaller, [members[g] for g in reversed(order)]


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The suffixes of integers in ascending order; the last symbol has to be the only least one."""
    group, smaller, groups = grouped(symbols)
    n, free, at = len(symbols), {}, 0
    for members in groups:
        if members:
            free[group[members[0]]] = at
            at += len(members)
    order, placed = [-1] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for r in range(n):
        s = order[r] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = smaller[s]
    return order


def longest_matches(symbols: np.ndarray, order: list[int]) -> list[int]:
    """Of each suffix, how many symbols it shares with the one that it shares most with: one of its neighbours in order."""
    n, s = len(symbols), symbols.tolist()
    before, best, k = [-1] * n, [0] * n, 0
    for x, y in zip(order, order[1:]):
        before[y] = x
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        while i + k < n and j + k < n and s[i + k] == s[j + k]:
            k += 1
        best[i] = max(best[i], k)
        best[j] = max(best[j], k)
        k = max(0, k - 1)
    return best
