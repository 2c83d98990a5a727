"""Suffix arrays by linear grouping.

Phase one keeps suffixes in groups that share a Lyndon prefix, at first by their first symbol, and goes through the
groups from the highest to the lowest. Each suffix points to the nearest position before it whose group is lower; the
positions that a group points to move to new groups right above their own, those that are pointed to more often the
higher. Phase two goes through the suffixes in their final order and places the chain of pointers of the position
before each. Neither phase renames symbols or recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``symbols``; its last symbol must be less than all others."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
    listed = order.tolist()
    members = [listed[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(np.arange(len(members)), np.diff(edges))
    group = group.tolist()
    below, over = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]  # neighbours in the order of groups
    pointer, done = [-1] * n, [False] * n

    current = len(members) - 1
    while current >= 0:
        mine = [p for p in members[current] if group[p] == current]
        for p in mine:
            done[p] = True
        pointed: dict[int, int] = {}
        for p in mine:
            q = p - 1
            while q >= 0 and done[q]:
                q = pointer[q]
            pointer[p] = q
            if q >= 0:
                pointed[q] = pointed.get(q, 0) + 1
        # the most pointed to first: each later group goes under it, right above the old one
        for times in sorted(set(pointed.values()), reverse=True):
            new: dict[int, int] = {}
            for q in sorted(q for q, t in pointed.items() if t == times):
                old = group[q]
                to = new.get(old)
                if to is None:
                    to = new[old] = len(members)
                    members.append([])
                    up = over[old]
                    below.append(old)
                    over.append(up)
                    over[old] = below[up] = to  # a group above always exists: the current one
                members[to].append(q)
                group[q] = to
        current = below[current]

    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += sum(1 for p in members[g] if group[p] == g)
        g = over[g]
    out, placed = [n - 1] * n, [False] * n
    placed[n - 1] = True
    start[group[n - 1]] += 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[start[g]] = p
            start[g] += 1
            placed[p] = True
            p = pointer[p]
    return np.array(out)
