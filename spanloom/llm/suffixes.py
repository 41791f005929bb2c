"""Suffix array in linear time by grouping.

The Lyndon prefix of a suffix is the longest Lyndon word it starts with; it ends where the next
smaller suffix begins. Phase one sorts the suffixes into groups of equal Lyndon prefix: groups start
as first characters and are taken in descending order. Each member of a group points to the nearest
earlier suffix of a smaller group (its previous smaller suffix); a suffix that l members point to has
their prefix l times behind its own, so it moves to a new group right above its old one, those with the
largest l highest. When all groups are done they are final. Phase two emits the order: the smallest
suffix is the end of the text, and each suffix that is placed places the one before it, and along
the pointers those before that, at the front of their groups. Nothing is renamed and solved again.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of `text` in ascending order (a suffix before its extensions)."""
    n = len(text) + 1  # the empty suffix is the smallest
    counts = [0] * 257
    counts[0] = 1
    for byte in text:
        counts[byte + 1] += 1
    starts, total = [0] * 257, 0
    for symbol, count in enumerate(counts):
        starts[symbol], total = total, total + count
    # The array is cut into groups: `first` gives the start of each suffix's group, `size` a group's
    # length at its start; `order` holds members, `where` their place in it.
    order, where, first, size = [0] * n, [0] * n, [0] * n, [0] * n
    free = starts[:]
    for i in range(n):
        symbol = text[i] + 1 if i < n - 1 else 0
        first[i] = starts[symbol]
        where[i] = free[symbol]
        order[free[symbol]] = i
        free[symbol] += 1
    for symbol, count in enumerate(counts):
        if count:
            size[starts[symbol]] = count

    smaller = [-1] * n  # previous smaller suffix
    end = n
    while end > 0:
        group = first[order[end - 1]]
        members = sorted(order[group:end])
        end = group
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and first[j] >= group:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[times]:
                moved.setdefault(first[j], []).append(j)
            for old, leaving in moved.items():
                # They swap to the end of the old group's range, which becomes their own group.
                border = old + size[old]
                for j in leaving:
                    border -= 1
                    at, other = where[j], order[border]
                    order[at], where[other] = other, at
                    order[border], where[j] = j, border
                for j in leaving:
                    first[j] = border
                if border > old:
                    size[border] = len(leaving)
                    size[old] -= len(leaving)

    result, front, placed = [-1] * n, size, [False] * n
    for start in range(n):
        front[start] = start  # next free place of the group that starts here
    result[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            group = first[s]
            result[front[group]] = s
            front[group] += 1
            placed[s] = True
            s = smaller[s]
    return result[1:]
