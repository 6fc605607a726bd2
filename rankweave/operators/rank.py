"""Unique global ranks, order statistics, and searches for rows at given ranks."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rankweave.operators.cutsearch import lookup, with_place
from rankweave.operators.scan import AT, PID, _carry, exclusive, in_order, partition_counts
from rankweave.spec import SortSpec


@dataclass
class Ranked:
    """Rows with ``rank`` (0-based, unique), how many there are, and the layout behind it."""

    df: DataFrame
    n: int
    counts: dict[int, int] = field(default_factory=dict)


def ranked(df: DataFrame, spec: SortSpec, partitions: int | None = None) -> Ranked:
    """Two passes: count the sorted partitions, then add each one's offset to its rows' places."""
    laid = in_order(df, spec, partitions)
    counts = partition_counts(laid, PID)
    out = _carry(laid, exclusive(counts), "_base", "long").withColumn("rank", F.col("_base") + F.col(AT))
    return Ranked(out.drop(PID, AT, "_base"), sum(counts.values()), counts)


def global_rank(df: DataFrame, spec: SortSpec, partitions: int | None = None) -> DataFrame:
    """Adds ``rank``: 0 .. n-1 in the order of `spec`."""
    return ranked(df, spec, partitions).df


def rank_and_count(df: DataFrame, spec: SortSpec, partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` and ``n``."""
    r = ranked(df, spec, partitions)
    return r.df.withColumn("n", F.lit(r.n).cast("long"))


def small_rank(df: DataFrame, spec: SortSpec, most: int = 100_000) -> DataFrame:
    """Adds ``rank`` by a window over one partition; refuses more rows than `most`."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; use global_rank")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*spec.orderings())).cast("long") - 1)


def bounds(df: DataFrame, spec: SortSpec, probe: Sequence[object]) -> DataFrame:
    """Rows before a key (lower bound) and rows not after it (upper bound)."""
    keys = SortSpec(spec.keys)
    return df.agg(
        F.count_if(keys.before(probe)).alias("lower_bound"),
        F.count_if(keys.before(probe, or_same=True)).alias("upper_bound"),
    )


def split_at_rank(one: DataFrame, two: DataFrame, spec: SortSpec, rank: int) -> DataFrame:
    """Of two inputs merged, the rows that come before `rank`; equal keys of the first lead.

    Adds ``source`` (1 or 2) and ``rank``.
    """
    both = one.withColumn("source", F.lit(1)).unionByName(two.withColumn("source", F.lit(2)))
    merged = SortSpec(spec.keys, (*SortSpec.by("source").keys, *spec.ties))
    return global_rank(both, merged).filter(F.col("rank") < rank)


def median(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """The lower median of a column as ``median``: exact, or from a mergeable sketch."""
    value = F.expr(f"percentile_disc(0.5) within group (order by {column})") if exact else F.percentile_approx(column, 0.5)
    return df.agg(value.alias("median"))


@dataclass
class Window_:
    """A target rank, the ranks accepted for it, and the nearest rows found on both sides.

    ``left``/``right``: (rank, key values); rows of rank < rank of right and >= rank of left are open.
    """

    target: int
    low: int
    high: int
    left: tuple[int, tuple | None]
    right: tuple[int, tuple | None]
    tied: bool = False  # the rows at the target equal the one at left

    @property
    def settled(self) -> bool:
        return self.tied or self.low <= self.left[0] or self.right[0] <= self.high

    @property
    def nearest(self) -> tuple[int, tuple | None]:
        a, b = self.left, self.right
        if not self.tied and self.low <= a[0] and b[0] <= self.high:
            return a if self.target - a[0] <= b[0] - self.target else b
        return a if self.tied or self.low <= a[0] else b

    def learn(self, first: int, after: int, at: tuple) -> None:
        """`first` rows come before `at`, and `after` rows come before or equal it."""
        if first <= self.target < after:
            self.left, self.tied = (first, at), first < self.low
        if self.left[0] <= first <= self.target:
            self.left = (first, at)
        if self.target <= first < self.right[0]:
            self.right = (first, at)


@dataclass
class Cut:
    """Rows before the cut, and the first row's keys and ties at it (None: the end)."""

    rank: int
    at: tuple | None


@dataclass
class Search:
    """What a search for cuts did: rounds (histograms taken) and rows that served as pivots."""

    rounds: int = 0
    pivots: int = 0


def multi_select(
    df: DataFrame, spec: SortSpec, targets: Sequence[int] | Callable[[int], tuple[list[int], int]], slack: int = 0, samples: int = 5, seed: int = 1, rounds: int = 500, pool: int = 128, done: Search | None = None
) -> list[Cut]:
    """Rows at about the target ranks, by repeated sampling and exact histograms.

    Each round takes random rows inside each range still open as pivots - `samples` for
    each target in it, or, if `samples` is 1, a single one: of the range's rows in the pool
    the one whose place among them is that of the middle target in the range.  It counts
    exactly how many rows come before each, and shrinks the ranges.  A target is settled once a row within
    `slack` of it is known, or once all rows there are equal: a cut is then before
    them.  Pivots come from a pool of about `pool` random rows a target, filled up
    for open ranges that have no row left in it; only these rows, and one count for each
    pivot, travel to the driver.  Targets still open after `rounds` rounds are an error.
    Targets may be a function that gives them, and the slack, from the number of rows.
    """
    done = done or Search()
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = df.select(*spec.values(), F.rand(seed).alias("_r")).persist()
    try:
        n = rows.count()
        if callable(targets):
            targets, slack = targets(n)
        flat, place_of = spec.flat(), spec.sort_key()
        found = [Window_(t, t - slack, t + slack, (0, None), (n, None)) for t in targets if t < n]
        held: list[tuple] = []
        for _ in range(rounds):
            open_ = [w for w in found if not w.settled]
            if not open_:
                break
            spans = sorted({(w.left, w.right) for w in open_}, key=lambda s: s[0][0])
            want = [sum((w.left, w.right) == s for w in open_) for s in spans]
            within = _by_span(held, spans, place_of)
            if not all(within):
                held = _drawn(rows, flat, spans, [pool * m for m in want], rng)
                within = _by_span(held, spans, place_of)
            pivots = []
            for some, m, span in zip(within, want, spans, strict=True):
                if samples == 1 and some:
                    aims = [w.target for w in open_ if (w.left, w.right) == span]
                    (a, _), (b, _) = span
                    share = (aims[len(aims) // 2] - a) / (b - a)
                    pivots.append(sorted(some, key=place_of)[min(len(some) - 1, int(share * len(some)))])
                else:
                    pivots += [some[k] for k in rng.permutation(len(some))[: samples * m]]
            if not pivots:
                continue
            pivots = sorted(set(pivots), key=place_of)
            done.rounds, done.pivots = done.rounds + 1, done.pivots + len(pivots)
            for (first, after), at in zip(_ranks(rows, flat, pivots), pivots, strict=True):
                for w in open_:
                    w.learn(first, after, at)
        if any(not w.settled for w in found):
            raise RuntimeError(f"cuts not within {slack} of their ranks after {rounds} rounds")
        first = None
        out = []
        for w in [Window_(t, t, t, (n, None), (n, None)) if t >= n else next(f for f in found if f.target == t) for t in targets]:
            rank, at = w.nearest
            if at is None and rank < n:
                first = first or tuple(rows.orderBy(*flat.orderings()).first())[:-1]
                at = first
            out.append(Cut(rank, at if rank < n else None))
        return out
    finally:
        rows.unpersist()


def _edges(spans: Sequence[tuple]) -> tuple[list[tuple], list[int]]:
    """Ascending edges of disjoint spans, and which span (-1: none) lies after each number of edges passed."""
    edges, owner = [], [-1]
    for k, ((_, a), (_, b)) in enumerate(spans):
        if a is not None and (not edges or edges[-1] != a):
            edges.append(a)
            owner.append(-1)
        owner[-1] = k
        if b is not None:
            edges.append(b)
            owner.append(-1)
    return edges, owner


def _by_span(held: Sequence[tuple], spans: Sequence[tuple], place_of: object) -> list[list[tuple]]:
    """The held rows that lie inside each span, without its first row."""
    edges, owner = _edges(spans)
    keys, out = [place_of(e) for e in edges], [[] for _ in spans]
    for row in held:
        k = owner[bisect_right(keys, place_of(row))]
        if k >= 0 and row != spans[k][0][1]:
            out[k].append(row)
    return out


def _drawn(rows: DataFrame, flat: SortSpec, spans: Sequence[tuple], wanted: Sequence[int], rng: np.random.Generator) -> list[tuple]:
    """About as many random rows of each span as wanted: those whose fixed random number
    lies in a random stretch of a length that fits the span's rows."""
    edges, owner = _edges(spans)
    share = [min(1.0, m / max(1, b[0] - a[0])) for (a, b), m in zip(spans, wanted, strict=True)]
    start = [float(rng.uniform(0, 1 - s)) for s in share]
    low = [start[k] if k >= 0 else 2.0 for k in owner]
    high = [(start[k] + share[k] if share[k] < 1 else 2.0) if k >= 0 else 2.0 for k in owner]
    names = [f"_k{i}" for i in range(len(flat.total))]
    placed = with_place(rows, flat.total, edges, "_span")
    inside = (F.col("_r") >= lookup(low, "_span", "double")) & (F.col("_r") < lookup(high, "_span", "double"))
    return list({tuple(r) for r in placed.filter(inside).select(*names).collect()})


def _ranks(rows: DataFrame, flat: SortSpec, cuts: Sequence[tuple]) -> list[tuple[int, int]]:
    """For each of the sorted cuts, exactly how many rows come before it, and before or at it."""
    placed = with_place(rows, flat.total, cuts, "_place", same="_same")
    counts = {(r._place, r._same): r.n for r in placed.groupBy("_place", "_same").agg(F.count("*").alias("n")).collect()}
    out, total = [], 0
    for k in range(len(cuts)):
        total += counts.get((k, False), 0)
        equal = counts.get((k + 1, True), 0)
        out.append((total, total + equal))
        total += equal
    return out


def boundaries(df: DataFrame, spec: SortSpec, groups: int, eps: float = 0.1, samples: int = 5, seed: int = 1, done: Search | None = None) -> list[Cut]:
    """Cuts between `groups` even groups; each within eps / 2 of a group of its ideal rank.

    samples=5: histogram sort with sampling; samples=1: one pivot for each open range.
    """
    plan = lambda n: ([k * n // groups for k in range(1, groups)], math.floor(eps * n / groups / 2))
    return multi_select(df, spec, plan, 0, samples, seed, done=done)
