"""Two-stage suffix sorting of a block of bytes, down to a fixed depth.

Stage one sorts the suffixes that are smaller than their successors; stage
two scans the buckets of first bytes in order and induces every other suffix
from its successor, which the scan has met before it.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``wanted`` (a mask) in the order of their first ``depth`` bytes.

    Only wanted suffixes and the successors that induce them are placed.
    Bytes after the end count as an arbitrary fixed ending.
    """
    n = len(data)
    text = np.concatenate([data, np.array([0, 255], np.uint8), np.zeros(depth, np.uint8)])
    step = np.diff(text[:n + 2].astype(np.int16))  # the ending makes suffix n smaller than its successor
    at = np.where(step != 0, np.arange(n + 1), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]  # next place where two neighbouring bytes differ
    smaller = step[decides] > 0
    next_smaller = np.minimum.accumulate(np.where(smaller, np.arange(n + 1), n)[::-1])[::-1]

    needed = np.zeros(n + 2, np.int32)
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    np.add.at(needed, last + 1, 1)
    np.add.at(needed, next_smaller[last] + 1, -1)  # nothing is added where the last one is smaller itself
    need = np.cumsum(needed[:n + 1]) > 0
    need[:n] |= wanted

    first = np.flatnonzero(need & smaller)
    keys = np.lib.stride_tricks.sliding_window_view(text, depth)[first]
    first = first[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    direct = np.searchsorted(text[first], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        placed = []
        current = np.concatenate(induced[c]) if induced[c] else first[:0]
        while current.size:  # equal bytes in a row: the bucket induces into itself
            placed.append(current)
            before = current[current > 0] - 1
            current = before[need[before] & (text[before] == c) & ~smaller[before]]
        placed.append(first[direct[c]:direct[c + 1]])
        bucket = np.concatenate(placed)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & ~smaller[before] & (text[before] > c)]
        if before.size:
            byte = text[before]
            before = before[np.argsort(byte, kind="stable")]
            found, starts = np.unique(text[before], return_index=True)
            for d, part in zip(found.tolist(), np.split(before, starts[1:])):
                induced[d].append(part)
    order = np.concatenate(out)
    return order[np.append(wanted, False)[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, rows: int = 1 << 14) -> np.ndarray:
    """Length of the common prefix, up to ``depth``, of each suffix in ``order`` with the next one."""
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(depth, np.uint8)]), depth)
    out = np.empty(max(len(order) - 1, 0), np.int64)
    for lo in range(0, len(out), rows):
        differ = windows[order[lo:lo + rows + 1]]
        differ = differ[1:] != differ[:-1]
        out[lo:lo + rows] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out
