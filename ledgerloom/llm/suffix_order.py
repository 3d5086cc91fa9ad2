"""Linear suffix sorting by grouping: suffixes of one Lyndon prefix form a group, groups are final before any order within them is."""

from __future__ import annotations


def _group(text: list[int]) -> tuple[list[int], list[int]]:
    """(first, smaller): of each suffix the first rank of its group, and the nearest suffix to its left in a lower group (-1 if none).

    Groups start as those of equal first symbols and are visited from the highest to the lowest. The suffixes of the visited
    group extend the Lyndon prefixes of the suffixes they point back to; those move to a new group right behind
    their old one, the further the more suffixes point to them. What has been visited stays as it is.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    at, first, size, smaller = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for k, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = k
        at[s], first[s] = k, start
        size[start] += 1
    top = n
    while top:
        low = first[order[top - 1]]
        if top - low == 1:
            s = order[low]
            p = s - 1
            while p >= 0 and first[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                old = first[p]
                left = size[old] - 1
                if left:
                    last, here = old + left, at[p]
                    q = order[last]
                    order[here], at[q], order[last], at[p] = q, here, p, last
                    size[old], first[p], size[last] = left, last, 1
        else:
            times: dict[int, int] = {}
            for s in sorted(order[low:top]):
                p = s - 1
                while p >= 0 and first[p] >= low:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            levels: dict[int, dict[int, list[int]]] = {}
            for p, k in times.items():
                levels.setdefault(k, {}).setdefault(first[p], []).append(p)
            for k in sorted(levels, reverse=True):
                for old, moved in levels[k].items():
                    left = size[old] - len(moved)
                    if not left:
                        continue
                    last = old + size[old]
                    for p in moved:
                        last -= 1
                        here, q = at[p], order[last]
                        order[here], at[q], order[last], at[p] = q, here, p, last
                    size[old], size[last] = left, len(moved)
                    for p in moved:
                        first[p] = last
        top = low
    return first, smaller


def suffix_order(text: list[int]) -> list[int]:
    """The starts of all suffixes of ``text`` in ascending order; its last symbol is smaller than all others.

    Both passes are linear but for the sorts by first symbol and within a visited group. Within a group, suffixes
    stand in the order of what follows their common prefix: the next smaller suffix. Ranks are given out in
    ascending order; a suffix that gets its rank places those it is the next smaller one of, found through the pointers, at
    the next free place of their groups. Nothing is renamed or sorted again.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    first, smaller = _group(text)
    free, out, placed = list(range(n)), [0] * n, bytearray(n)  # free: the next rank to give out, by a group's first
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            g = first[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = smaller[p]
    return out
