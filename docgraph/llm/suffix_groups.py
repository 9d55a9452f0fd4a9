"""Suffix sorting by linear grouping: Lyndon-prefix groups in descending order, then each group's order in one sweep."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Positions of the suffixes of s in order.

    First part: suffixes begin in groups by their first symbol. Groups are taken in descending order. A suffix points to
    the nearest earlier suffix of a lower group (its previous smaller); those pointed at are longer Lyndon prefixes than
    the rest of their groups, so they move to new groups just above, the ones pointed at more often higher. In the end
    a group holds the suffixes that share their longest Lyndon prefix, and the groups are in order.
    Second part: suffixes in ascending order; each places the suffixes whose Lyndon prefix ends before it, found by
    the pointers, at the next place of their groups. Nothing is renamed or sorted again.
    """
    n = len(s)
    if n == 0:
        return []
    # a sentinel below all symbols ends the text
    symbols = sorted(set(s))
    number = {x: i + 1 for i, x in enumerate(symbols)}
    group = [number[x] for x in s]
    group.append(0)
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    # groups form a chain from high to low; rank grows with the order and is only compared between linked groups
    below = [g - 1 for g in range(len(members))]
    above = [g + 1 for g in range(len(members))]
    above[-1] = -1
    done = bytearray(len(members))
    previous = [-1] * (n + 1)
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        mine.sort()
        members[g] = mine
        done[g] = 1
        votes: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                votes[j] = votes.get(j, 0) + 1
        if votes:
            if len(votes) == 1:
                layers = [list(votes)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, v in votes.items():
                    by_count.setdefault(v, []).append(j)
                layers = [by_count[v] for v in sorted(by_count, reverse=True)]
            for layer in layers:
                new: dict[int, int] = {}
                for j in layer:
                    old = group[j]
                    to = new.get(old)
                    if to is None:
                        to = new[old] = len(members)
                        members.append([])
                        done.append(0)
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = to
                        if up >= 0:
                            below[up] = to
                    group[j] = to
                    members[to].append(j)
        g = below[g]
    # places of the groups, lowest first
    start = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * (n + 1)
    placed = bytearray(n + 1)
    order[0] = n
    placed[n] = 1
    start[group[n]] = 1
    for k in range(n + 1):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            h = group[j]
            order[start[h]] = j
            start[h] += 1
            j = previous[j]
    return order[1:]


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """For each place of the order, how many symbols its suffix shares with the suffix before; 0 for the first."""
    n = len(s)
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    out = [0] * n
    h = 0
    for i in range(n):
        k = place[i]
        if k:
            j = order[k - 1]
            most = n - max(i, j)
            while h < most and s[i + h] == s[j + h]:
                h += 1
            out[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
