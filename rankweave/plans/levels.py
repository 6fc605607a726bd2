"""Sizes and quotas: how many groups, samples and splitters a sort wants."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def pow2_at_most(p: int) -> int:
    """The largest power of two that is at most p."""
    return 1 << (p.bit_length() - 1)


def even_sizes(n: int, slots: int) -> list[int]:
    """n split evenly over slots, the larger parts first."""
    size, more = divmod(n, slots)
    return [size + (k < more) for k in range(slots)]


def rank_of_slot(slot: int, n: int, slots: int) -> int:
    """First rank of a slot of the even split."""
    size, more = divmod(n, slots)
    return slot * size + min(slot, more)


def slot_of(rank: int, n: int, slots: int) -> tuple[int, int]:
    """Slot of a rank, and its position there."""
    size, more = divmod(n, slots)
    wide = more * (size + 1)
    if rank < wide:
        return divmod(rank, size + 1)
    slot, offset = divmod(rank - wide, size)
    return slot + more, offset


def subgroups(p: int, k: int) -> list[int]:
    """Sizes of the groups that p slots are divided into on one level: min(k, p) of them."""
    return even_sizes(p, min(k, p))


def groups_for_levels(p: int, levels: int) -> int:
    """Groups a level so that `levels` levels reach p slots; a power of two."""
    return 1 << math.ceil(math.ceil(math.log2(max(p, 1))) / levels) if p > 1 else 1


def level_plan(p: int, ks: Sequence[int] | int) -> list[list[int]]:
    """Group sizes of every level until all groups are single slots.

    `ks`: groups of each level (their product must reach p), or one number for all.
    """
    if not isinstance(ks, int) and math.prod(ks) < p:
        raise ValueError("the levels' groups do not reach all slots")
    if isinstance(ks, int) and ks < 2 and p > 1:
        raise ValueError("a level needs two groups at least")
    out, sizes, level = [], [p], 0
    while max(sizes) > 1:
        k = ks if isinstance(ks, int) else ks[level]
        sizes = [s for size in sizes for s in subgroups(size, k)]
        out.append(sizes)
        level += 1
    return out


def level_imbalance(eps: float, levels: int, level: int, actual: int, initial: int) -> float:
    """Imbalance that level `level` (the last is 0) may add: an even share of (1 + eps),
    or more if earlier levels used less."""
    if not initial or not levels:
        return eps
    share = (1 + eps) ** (1 / levels) - 1
    return max(share, (1 + share) ** (level + 1) - 1 - (actual / initial - 1))


def splitter_sizes(p: int, groups: int, eps: float) -> tuple[int, int, int]:
    """Over-partitioning b, splitters and samples for a bound of 1 + eps."""
    b = math.ceil(2 / eps)
    a = math.ceil(13 * max(1, math.ceil(math.log2(max(p, 2)))) / b)
    return b, b * groups - 1, a * groups * b


def pivot_samples(n: int, p: int, least: int = 64, added: bool = False) -> int:
    """Samples for a median pivot; an odd number, -1 without rows."""
    if n <= 0:
        return -1
    base, share = int(16 * math.log2(max(p, 1))), int(n / p / 50)  # each cut off by itself
    count = max(base + share, least) if added else max(base, share, least)
    return count if count % 2 else count + 1


def multinomial_quota(sizes: Sequence[int], total: int, seed: int) -> list[int]:
    """How many of `total` draws with replacement fall into parts of these sizes."""
    n = sum(sizes)
    if not n:
        return [0] * len(sizes)
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.multinomial(total, np.array(sizes, float) / n).tolist()


def equal_quota(parts: int, total: int, seed: int) -> list[int]:
    """`multinomial_quota` of equal parts."""
    return multinomial_quota([1] * parts, total, seed)


def ceil_root(n: int, k: int) -> int:
    """The least r with r ** k >= n."""
    r = max(0, round(n ** (1 / k)) - 2) if n > 0 else 0
    while r**k < n:
        r += 1
    return r


def floor_log(n: int, base: int) -> int:
    """The greatest e with base ** e <= n, for n >= 1."""
    e = 0
    while base ** (e + 1) <= n:
        e += 1
    return e


def ternary_levels(n: int) -> list[int]:
    """Sizes of the levels of a median-of-three tree over the first 3 ** floor_log(n, 3) of n values."""
    e = floor_log(n, 3) if n else -1
    return [3**k for k in range(e, -1, -1)]
