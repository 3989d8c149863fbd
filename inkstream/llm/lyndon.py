"""Suffix arrays by linear grouping.

First suffixes are grouped by their longest Lyndon prefix.  Groups are taken
in descending order; the members' previous smaller suffixes (their parents)
are then extended by the group's word, so parents with more children in the
group move into higher groups right behind the one they leave.  Then suffixes
are emitted in ascending order: each emitted suffix releases those whose next
smaller suffix it is, into the next free place of their group.  No recursion,
no renaming.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of an integer string whose last symbol is its smallest and occurs once."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    members = [x.tolist() for x in np.split(order, cuts[1:])]
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(np.arange(len(cuts)), np.diff(np.concatenate((cuts, [n]))))
    group = group.tolist()
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    parent = [-1] * n
    done = [False] * len(members)
    descending: list[list[int]] = []

    at = len(members) - 1
    while at >= 0:
        own = sorted(i for i in members[at] if group[i] == at)
        children: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and (done[group[j]] or group[j] == at):
                j = parent[j]
            parent[i] = j
            if j >= 0:
                children[j] = children.get(j, 0) + 1
        done[at] = True
        if own:
            descending.append(own)
        # parents by the number of their children here and the group that they leave, most children first
        moves: dict[tuple[int, int], list[int]] = {}
        for p, c in children.items():
            moves.setdefault((-c, group[p]), []).append(p)
        for c, g in sorted(moves) if len(moves) > 1 else moves:
            new = len(members)
            members.append(moves[c, g])
            done.append(False)
            for p in moves[c, g]:
                group[p] = new
            # right above the group left, so below the parents with more children
            up = above[g]
            below.append(g)
            above.append(up)
            above[g] = new
            if up >= 0:
                below[up] = new
        at = below[at]

    free, k = [0] * len(members), 0
    for own in reversed(descending):
        free[group[own[0]]] = k
        k += len(own)
    out = [-1] * n
    out[0] = n - 1
    emitted = [False] * n
    emitted[n - 1] = True
    for s in out:  # grows ahead of this loop
        j = s - 1
        while j >= 0 and not emitted[j]:
            emitted[j] = True
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = parent[j]
    return np.array(out, dtype=np.int64)
