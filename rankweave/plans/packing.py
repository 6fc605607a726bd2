"""Packing buckets into slots in order, under the least capacity that works.

Buckets hold ranges of keys.  A divisible bucket (all keys equal) may be cut
anywhere; any other one stays whole.  Filling slots greedily in order is optimal
for a given capacity, and more capacity never hurts, so the least capacity is
found by bisection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Bucket:
    size: int
    divisible: bool = False


def fill(buckets: Sequence[Bucket], capacity: int) -> list[int]:
    """Sizes of the slots that greedy filling uses; empty if some bucket fits in no slot."""
    out, used, begun = [], 0, False
    for b in buckets:
        size = b.size
        if not b.divisible:
            if size > capacity:
                return []
            if used + size > capacity:
                out.append(used)
                used = 0
            used += size
        else:
            while size > capacity - used:
                size -= capacity - used
                out.append(capacity)
                used = 0
            used += size
        begun = True
    if begun:
        out.append(used)
    return out


def fits(buckets: Sequence[Bucket], slots: int, capacity: int) -> bool:
    used = fill(buckets, capacity)
    return (bool(used) or not any(b.size for b in buckets)) and len(used) <= slots


def least_capacity(buckets: Sequence[Bucket], slots: int) -> int:
    """The smallest capacity under which the buckets fit into the slots in order."""
    total = sum(b.size for b in buckets)
    low = max(-(-total // slots), max((b.size for b in buckets if not b.divisible), default=0))
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if fits(buckets, slots, mid):
            high = mid
        else:
            low = mid + 1
    return low


def cuts(buckets: Sequence[Bucket], slots: int) -> list[int]:
    """Global positions at which slots 1, 2, ... begin under the least capacity."""
    sizes = fill(buckets, least_capacity(buckets, slots))
    out, at = [], 0
    for size in sizes[:-1]:
        at += size
        out.append(at)
    return out


def splits_of(sizes: Sequence[Sequence[int]], bounds: Sequence[int]) -> list[list[list[int]]]:
    """For each part (input partition) and bucket, how many rows go to each slot.

    sizes[part][bucket]: rows; bounds: global positions where slots begin, buckets laid
    out in order and within a bucket the parts in order.
    """
    parts, buckets = len(sizes), len(sizes[0]) if sizes else 0
    edges = [0, *bounds, sum(map(sum, sizes))]
    out = [[[0] * (len(edges) - 1) for _ in range(buckets)] for _ in range(parts)]
    at = 0
    for b in range(buckets):
        for p in range(parts):
            n = sizes[p][b]
            for s in range(len(edges) - 1):
                out[p][b][s] = max(0, min(at + n, edges[s + 1]) - max(at, edges[s]))
            at += n
    return out


def overlaps(x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int, int]]:
    """Two divisions of one line into stripes of these sizes: (i, j, length) of each overlap."""
    out, i, j, end_x, end_y, at = [], 0, 0, 0, 0, 0
    while True:
        while end_x <= at and i < len(x):
            end_x += x[i]
            i += 1
        while end_y <= at and j < len(y):
            end_y += y[j]
            j += 1
        to = min(end_x, end_y)
        if to <= at:
            return out
        out.append((i - 1, j - 1, to - at))
        at = to
