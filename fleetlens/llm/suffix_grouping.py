"""Suffix array by linear grouping (Baier 2016), for integer texts.

Phase 1 refines groups of suffixes until each holds those that begin with the
same Lyndon word up to their next smaller suffix. Groups are taken from the
highest to the lowest; every member finds its previous smaller suffix by
pointers of members before it, and suffixes that are previous-smaller to
members of the group move, by how many members they have, into new groups just
above their own. Phase 2 emits every group's order from the order of the next
smaller suffixes, in one scan. There is no recursion and no renaming.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions of the suffixes of ``symbols`` in order.

    The last symbol must be smaller than all others.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1]))
    starts = np.flatnonzero(first)
    group_start = starts[np.cumsum(first) - 1]
    group = np.empty(n, dtype=np.int64)
    group[order] = group_start
    place_of = np.empty(n, dtype=np.int64)
    place_of[order] = np.arange(n)
    sizes = np.zeros(n + 1, dtype=np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    # Plain lists: single reads and writes are several times faster than in arrays.
    line, group, place, size = order.tolist(), group.tolist(), place_of.tolist(), sizes.tolist()
    prev = [-1] * n

    end = n
    while end > 0:
        g = group[line[end - 1]]
        members = line[g:end]
        if len(members) > 1:
            members.sort()
        end = g
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if not count:
            continue
        by_count: dict[int, list[int]] = {}
        for p, k in count.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                old = group[p]
                last = old + size[old] - 1
                size[old] -= 1
                other, at = line[last], place[p]
                line[at], line[last] = other, p
                place[other], place[p] = at, last
                if old in moved:
                    moved[old].append(p)
                else:
                    moved[old] = [p]
            for old, ps in moved.items():
                new = old + size[old]
                if new != old:  # else all of the group moved, and it stays one group
                    for p in ps:
                        group[p] = new
                size[new] = len(ps)

    out = [0] * n
    free: dict[int, int] = {}
    out[0] = n - 1
    for rank in range(n):
        s = out[rank]
        stop = prev[s]
        j = s - 1
        while j > stop:
            g = group[j]
            at = free.get(g, g)
            out[at] = j
            free[g] = at + 1
            j = prev[j]
    return out
