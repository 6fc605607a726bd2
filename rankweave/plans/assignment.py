"""Messages to receivers within their capacities, with few messages for each receiver.

Small messages stay whole and are dealt first, so many to a receiver that it has
capacity left; large ones fill what is left, and are cut where a receiver is full.
"""

from __future__ import annotations

from collections.abc import Sequence

from rankweave.plans.packing import overlaps


def small_limit(messages: int, capacity: Sequence[int]) -> int:
    """Up to this size a message is small: its receiver's share of small ones fills half of it at most."""
    return min(capacity) // 2 // max(1, -(-messages // len(capacity)))


def most_messages(messages: int, receivers: int) -> int:
    """Messages and parts of messages that one receiver gets at most: its share of the small
    ones, and of the large ones a begin, an end, and as many between as fit."""
    share = -(-messages // receivers)
    return 3 * share + 2


def assign(sizes: Sequence[int], capacity: Sequence[int]) -> list[tuple[int, int, int]]:
    """(message, receiver, length) of each part; the capacities must hold all messages."""
    if sum(sizes) > sum(capacity):
        raise ValueError("the receivers do not hold the messages")
    limit, left, out = small_limit(len(sizes), capacity), list(capacity), []
    share = -(-len(sizes) // len(capacity))
    small = [k for k, n in enumerate(sizes) if 0 < n <= limit]
    for place, k in enumerate(small):
        left[place // share] -= sizes[k]
        out.append((k, place // share, sizes[k]))
    large = [k for k, n in enumerate(sizes) if n > limit]
    return out + [(large[i], to, n) for i, to, n in overlaps([sizes[k] for k in large], left)]
