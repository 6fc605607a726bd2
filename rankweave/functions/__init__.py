"""Column expressions: searching constants, and arithmetic between ranks and slots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def search(n: int, below: Callable[[int], Column], start: int = 0) -> Column:
    """How many of the constants start..n-1, in ascending order, `below` says a row lies beyond.

    A binary search written out as nested conditions, so it compiles to a few
    comparisons for each row; for a few dozen constants (``with_place`` for more).
    """
    if start >= n:
        return F.lit(start)
    mid = (start + n) // 2
    return F.when(below(mid), search(n, below, mid + 1)).otherwise(search(mid, below, start))


def bucket_of(value: Column, cuts: Sequence[object]) -> Column:
    """How many of the sorted `cuts` are at most `value`."""
    return search(len(cuts), lambda k: value >= F.lit(cuts[k])).cast("int")


def whole(a: Column, by: int) -> Column:
    """Integer division of longs by a positive constant, without a detour over doubles."""
    return F.call_function("div", a.cast("long"), F.lit(by).cast("long"))


def slot_of_rank(rank: Column, n: int, slots: int) -> Column:
    """Slot of a rank if n ranks are split evenly: the first n % slots get one more."""
    size, more = divmod(n, slots)
    wide = more * (size + 1)
    if size == 0:
        return rank.cast("int")
    return F.when(rank < wide, whole(rank, size + 1)).otherwise(whole(rank - wide, size) + more).cast("int")


def offset_in_slot(rank: Column, n: int, slots: int) -> Column:
    """Position of a rank within its slot under the even split."""
    size, more = divmod(n, slots)
    wide = more * (size + 1)
    if size == 0:
        return F.lit(0).cast("long")
    return F.when(rank < wide, rank % (size + 1)).otherwise((rank - wide) % size).cast("long")
