"""Maximal periodic runs of many word sequences from an enhanced suffix array.

The suffixes of all sequences are sorted together by doubling, each sequence
apart; the ranks of every doubling round stay and answer how far two places
agree.  An interval of the suffix array whose suffixes share exactly
``depth`` words is found from the next smaller entries on both sides of its
borders; no tree is built.  Within an interval, all suffixes outside the
largest child look whether the suffix ``depth`` words on (or back) lies in
the interval too, but in another child: then a square of two parts of
``depth`` words starts there, and the next word breaks it.  Turned to the
left as far as the words agree, the square becomes a run; runs of a multiple
of the smallest period have the same ends and merge into it.
"""

from __future__ import annotations

import numpy as np


def _doubling(words: np.ndarray, seq: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and per round k the rank of each place by its next ``2**k`` words.

    Equal ranks mean equal words: a suffix that ends early differs from all
    others of its sequence.
    """
    n = len(words)
    key = seq * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    ranks = [rank]
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    width = 1
    while slots.size:  # only places whose words still occur elsewhere are sorted again
        at = order[slots]
        after = at + width
        follows = np.where(after < stop[at], rank[np.minimum(after, n - 1)], -1)
        key = rank[at] * (n + 1) + follows + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        head = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        ranks.append(rank)
        slots = slots[~(head & np.append(head[1:], True))]
        width *= 2
    return order, ranks


def _common_prefixes(order: np.ndarray, ranks: list[np.ndarray], stop: np.ndarray) -> np.ndarray:
    """Shared words of each suffix in order with the one before; 0 where the sequence changes, and at both ends."""
    n = len(order)
    out = np.zeros(n + 1, np.int64)
    slot = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[slot - 1], order[slot]
    shared = np.zeros(len(slot), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < stop[a]) & (y < stop[b])
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        shared[same] += 1 << k
    out[slot] = shared
    return out


def _smaller_beside(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each border in ``at``: the nearest borders on both sides with a smaller entry."""
    mins = [lcp]
    while len(mins[-1]) > 1 << len(mins):  # minima of 2, 4, 8 … entries
        half = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][:-half], mins[-1][half:]))
    value, left, right = lcp[at], at.copy(), at + 1
    for k in range(len(mins) - 1, -1, -1):
        size, low = 1 << k, mins[k]
        start = left - size
        free = (start >= 0) & (low[np.maximum(start, 0)] >= value)
        left[free] -= size
        free = (right + size <= len(lcp)) & (low[np.minimum(right, len(low) - 1)] >= value)
        right[free] += size
    return left - 1, right


def _branching_squares(order: np.ndarray, lcp: np.ndarray, start: np.ndarray, stop: np.ndarray
                       ) -> tuple[np.ndarray, np.ndarray]:
    """Places and part lengths of all squares that the next word breaks, up to a quarter of their sequence."""
    n = len(order)
    none = np.zeros(0, np.int64)
    whole = (stop - start)[order[np.minimum(np.arange(n + 1), n - 1)]]
    border = np.flatnonzero((lcp > 0) & (4 * lcp <= whole))  # a run holds its period four times
    if not border.size:
        return none, none
    lo, hi = _smaller_beside(lcp, border)
    by = np.argsort(lo * (n + 1) + hi, kind="stable")
    border, lo, hi = border[by], lo[by], hi[by]
    first = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    begins = np.flatnonzero(first)
    interval = np.cumsum(first) - 1
    # children of an interval: from its left end, and from each of its borders, to the next border or its right end
    child_lo = np.insert(border, begins, lo[begins])
    child_of = np.insert(interval, begins, interval[begins])
    ends = np.append(begins[1:], len(border)) - 1
    child_hi = np.empty(len(child_lo), np.int64)
    child_hi[:-1] = child_lo[1:]
    last = ends + np.arange(len(begins)) + 1
    child_hi[last] = hi[begins]
    size = child_hi - child_lo
    heads = begins + np.arange(len(begins))
    largest = np.maximum.reduceat(size, heads)
    number = np.where(size == largest[child_of], np.arange(len(size)), len(size))
    small = np.ones(len(size), bool)
    small[np.minimum.reduceat(number, heads)] = False
    child_lo, child_hi, child_of, size = child_lo[small], child_hi[small], child_of[small], size[small]
    # every suffix of the smaller children
    child = np.repeat(np.arange(len(size)), size)
    slot = child_lo[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
    depth = lcp[border[begins]][child_of[child]]
    left, right = lo[begins][child_of[child]], hi[begins][child_of[child]]
    own_lo, own_hi = child_lo[child], child_hi[child]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = order[slot]
    found, parts = [], []
    for step, where in ((depth, at + depth), (-depth, at - depth)):
        inside = (where >= start[at]) & (where < stop[at])
        met = place[np.clip(where, 0, n - 1)]
        hit = inside & (met >= left) & (met < right) & ((met < own_lo) | (met >= own_hi))
        found.append(np.minimum(at, at + step)[hit])
        parts.append(depth[hit])
    squares = np.unique(np.stack([np.concatenate(found), np.concatenate(parts)], axis=1), axis=0)
    return squares[:, 0], squares[:, 1]


def _turned_left(at: np.ndarray, period: np.ndarray, ranks: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """How far each square goes to the left: the first place from which the words repeat after ``period``."""
    first, floor = at.copy(), start[at]
    for k in range(len(ranks) - 1, -1, -1):
        before = first - (1 << k)
        inside = before >= floor
        before = np.maximum(before, 0)
        same = inside & (ranks[k][before] == ranks[k][before + period])
        first[same] -= 1 << k
    return first


def periodic_runs(words: np.ndarray, lengths: np.ndarray, least: int = 6, times: int = 4
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(sequence, start, length, period)`` of the runs of at least ``least`` words and ``times`` (4 or more) periods.

    ``words`` holds the numbered words of all sequences one after another,
    ``lengths`` how many belong to each.  Sorted by sequence, start, period.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none, none
    ends = np.cumsum(lengths)
    seq = np.repeat(np.arange(len(lengths)), lengths)
    start, stop = (ends - lengths)[seq], ends[seq]
    order, ranks = _doubling(words.astype(np.int64), seq, stop)
    at, period = _branching_squares(order, _common_prefixes(order, ranks, stop), start, stop)
    first = _turned_left(at, period, ranks, start)
    end = at + 2 * period
    keep = end - first >= np.maximum(least, times * period)
    first, end, period = first[keep], end[keep], period[keep]
    by = np.lexsort((period, end, first))
    first, end, period = first[by], end[by], period[by]
    if len(first):
        keep = np.append(True, (first[1:] != first[:-1]) | (end[1:] != end[:-1]))
        first, end, period = first[keep], end[keep], period[keep]
    by = np.lexsort((period, first))
    first, end, period = first[by], end[by], period[by]
    return seq[first], first - start[first], end - first, period
