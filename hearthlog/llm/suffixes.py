"""Suffix arrays by grouping, in linear time and without recursion (Baier, 2016)."""

import sys
from collections import defaultdict

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes of ``symbols`` in lexicographic order.

    First the suffixes are grouped by their Lyndon prefix. Groups are visited from the
    highest down; a suffix points to the closest one before it that is in a lower
    group, and that one's prefix is thereby known to go on with the visited group's:
    it moves to a group right above its own, the higher the more suffixes point to it.
    Then the order within groups follows from the order of what comes after the
    prefixes, smallest suffix first.
    """
    n = len(symbols)
    group_of = [0] * n
    members: list[list[int]] = []
    above: list[int] = []  # the next group up, -1 at the top
    below: list[int] = []
    ranked = sorted(set(symbols))
    number = {s: g for g, s in enumerate(ranked)}
    members = [[] for _ in ranked]
    for at, s in enumerate(symbols):
        group_of[at] = number[s]
        members[number[s]].append(at)
    above = [*range(1, len(ranked)), -1]
    below = [*range(-1, len(ranked) - 1)]
    lower_before = [-2] * n  # -2: not visited
    current = len(ranked) - 1
    while current >= 0:
        pointed: dict[int, int] = defaultdict(int)
        own = sorted([i for i in members[current] if group_of[i] == current])
        members[current] = own
        for i in own:
            j = i - 1
            while j >= 0 and lower_before[j] != -2:
                j = lower_before[j]
            lower_before[i] = j
            if j >= 0:
                pointed[j] += 1
        by_count: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, times in pointed.items():
            by_count[times][group_of[j]].append(j)
        for times in sorted(by_count, reverse=True):
            for old, moved in by_count[times].items():
                new = len(members)
                members.append(moved)
                over = above[old]
                above.append(over)
                below.append(old)
                above[old] = new
                if over >= 0:
                    below[over] = new
                for j in moved:
                    group_of[j] = new
        current = below[current]
    return _emit(n, group_of, members, above, below)


def _emit(n: int, group_of: list[int], members: list[list[int]], above: list[int], below: list[int]) -> list[int]:
    lowest = next((g for g in range(len(members)) if below[g] == -1), -1)
    rank, slot, filled = [0] * len(members), [0] * len(members), 0
    g, at = lowest, 0
    while g >= 0:
        rank[g], slot[g] = at, filled
        filled += sum(1 for i in members[g] if group_of[i] == g)
        g, at = above[g], at + 1
    # The prefix of a suffix ends where the next one of its group or a lower one starts.
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    waiting: list[int] = []
    for i in range(n):
        r = rank[group_of[i]]
        while waiting and rank[group_of[waiting[-1]]] >= r:
            ending[i].append(waiting.pop())
        waiting.append(i)
    ending[n] = waiting
    order = [-1] * n
    for j in ending[n]:
        g = group_of[j]
        order[slot[g]] = j
        slot[g] += 1
    for place in range(n):
        for j in ending[order[place]]:
            g = group_of[j]
            order[slot[g]] = j
            slot[g] += 1
    return order


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each place of the suffix array, how many symbols its suffix shares with the
    one before (Kasai's method)."""
    n = len(symbols)
    place = [0] * n
    for at, start in enumerate(order):
        place[start] = at
    shared, length = [0] * n, 0
    for i in range(n):
        if place[i] == 0:
            length = 0
            continue
        j = order[place[i] - 1]
        while i + length < n and j + length < n and symbols[i + length] == symbols[j + length]:
            length += 1
        shared[place[i]] = length
        length -= length > 0
    return shared
