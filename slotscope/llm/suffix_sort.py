"""Suffix sorting by Lyndon-prefix groups, and the repeats that neighbouring suffixes show."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order (a suffix before what it is a prefix of).

    Suffixes start out grouped by their first symbol. Groups are processed from the largest down:
    each member gets a pointer to the nearest earlier suffix in a smaller group, and what is pointed
    at k times has the group's word k times after its own, so it moves to a new group just above its
    old one. In the end every group holds the suffixes with one Lyndon prefix. One sweep over the
    emerging order then fills each group from its front: the predecessor of every emitted suffix
    comes next in its group, and so do the suffixes along its pointers.
    """
    n = len(symbols)
    if not n:
        return []
    by_symbol = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, symbols[by_symbol][1:] != symbols[by_symbol][:-1]])
    members: list[list[int]] = [g.tolist() for g in np.split(by_symbol, first[1:])]
    count = len(members)
    above = list(range(1, count)) + [-1]  # the groups in order, linked both ways
    below = list(range(-1, count - 1))
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    done = [False] * count
    smaller = [-1] * n
    order = []
    g = count - 1
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]  # without those that moved up
        done[g] = True
        if own:
            order.append(g)
            times: dict[int, int] = {}
            for i in own:  # ascending, so pointers inside the group are there when needed
                p = i - 1
                while p >= 0 and done[group[p]]:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                moves.setdefault((k, group[p]), []).append(p)
            for k, h in sorted(moves, reverse=True):  # most times first: what comes later slips in below it
                moved = sorted(moves[k, h])
                new = len(members)
                members.append(moved)
                done.append(False)
                for p in moved:
                    group[p] = new
                above.append(above[h])
                below.append(h)
                below[above[h]] = new
                above[h] = new
        g = below[g]
    start: dict[int, int] = {}
    at = 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = [False] * n
    i, j = -1, n - 1
    while True:
        while j >= 0 and not placed[j]:
            out[start[group[j]]] = j
            start[group[j]] += 1
            placed[j] = True
            j = smaller[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1


def longest_shared(symbols: np.ndarray, order: list[int]) -> list[int]:
    """For each start, how many symbols its suffix shares with the neighbour in ``order`` that shares more."""
    n = len(symbols)
    text = symbols.tolist()
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    best = [0] * n
    h = 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            if h > best[i]:
                best[i] = h
            if h > best[j]:
                best[j] = h
            if h:
                h -= 1
        else:
            h = 0
    return best
