"""Sorters: global order under different contracts on where rows land.

All of them return the rows with ``pid`` (the partition that a row is in), in one
physical partition for each pid, sorted within.  They differ in what they promise
about the partitions' sizes, in how equal keys may spread, and in what they cost:

======================  ==========================================================
``over_partition_sort``  at most (1 + eps) times the even load, equal keys may spread
``histogram_sort``       cuts within eps / 2 of a group's even share, by sampled histograms
``select_sort``          the same by one pivot for each open range
``balanced_sort``        exactly even, the first partitions one row more
``rank_sort``            blocks of equal size on a power of two of partitions
``packed_sort``          left-packed: partitions full up to a given size
``quick_sort``           a power of two of partitions, by one range exchange
``one_each``             one row a partition
``merge_bitonic``        a decreasing and an increasing run, merged
======================  ==========================================================

Sorts by cuts and range exchanges move rows once.  Those that place rows by rank
(balanced, rank, packed) move them twice: into a range layout whose partitions are
counted, and from there, mostly to a neighbouring place, by rank.  Levels of recursion
would only move them again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from rankweave.operators import splitters as S
from rankweave.operators.cutsearch import lookup
from rankweave.operators.exchange import block_pid, even_pid, to_partition, with_bound_pid, with_cut_pid
from rankweave.operators.merge import reversed_spec
from rankweave.operators.metrics import SortMetrics
from rankweave.operators.rank import Search, boundaries, ranked, small_rank
from rankweave.operators.scan import AT, PID, default_partitions, exclusive, kept, partition_counts
from rankweave.plans.levels import pow2_at_most, splitter_sizes
from rankweave.plans.packing import Bucket, cuts, least_capacity
from rankweave.spec import Key, SortSpec


def plain_sort(df: DataFrame, spec: SortSpec) -> DataFrame:
    """Global order without a contract on placement: Spark's own sort."""
    return df.orderBy(*spec.orderings())


def over_partition_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None, eps: float = 0.1, equal_buckets: bool = True, seed: int = 1, metrics: SortMetrics | None = None) -> DataFrame:
    """Many small buckets between sampled splitters, packed under the least capacity.

    Ties belong to the order, so with ties no bucket holds many equal rows and the bound
    of (1 + eps) holds whatever the keys.  Without ties, a bucket of equal keys is cut at
    exact places, in any order of its rows; without equal buckets too, equal keys stay
    together and may unbalance.  The driver plans over the sizes of buckets, of which
    there are about 40 a partition.
    """
    p, m = partitions or default_partitions(df), metrics or SortMetrics()
    _, count, samples = splitter_sizes(p, p, eps)
    with m.phase("sampling"):
        chosen = S.sampled_splitters(df, spec, samples, count, seed)
    m.add("samples", samples)
    m.add("splitters", len(chosen))
    rows = S.with_bucket(df, spec.total, chosen, equal_buckets, "_bucket")
    with m.phase("partition"):
        totals = {r["_bucket"]: r.n for r in rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    order = sorted(totals)
    with m.phase("packing"):
        buckets = [Bucket(totals[b], equal_buckets and b % 2 == 1) for b in order]
        bounds = cuts(buckets, p)
        m.add("capacity", least_capacity(buckets, p))
    begin = exclusive(totals)
    pid_of = [bisect_right(bounds, begin.get(b, 0)) for b in range(max(totals, default=0) + 1)]
    split = [b for b in order if bisect_left(bounds, begin[b] + totals[b]) > pid_of[b]]
    placed = rows.withColumn("pid", lookup(pid_of, "_bucket").cast("int"))
    if split:
        placed = placed.filter(~F.col("_bucket").isin(split)).unionByName(_cut_buckets(rows.filter(F.col("_bucket").isin(split)), begin, bounds))
    with m.phase("exchange"):
        return to_partition(placed.drop("_bucket"), "pid", p, spec)


def _cut_buckets(rows: DataFrame, begin: dict[int, int], bounds: list[int]) -> DataFrame:
    """``pid`` of rows in buckets that bounds cut: a row's position is its bucket's, after that
    of earlier input partitions, after its own partition's earlier rows of the bucket."""
    laid = rows.withColumn(PID, F.spark_partition_id()).sortWithinPartitions("_bucket").withColumn(AT, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    laid = kept(laid)
    # one row for each input partition and cut bucket; joined by what size it turns out to have
    sizes = laid.groupBy(PID, "_bucket").agg(F.count("*").alias("_n"), F.min(AT).alias("_from"))
    earlier = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(PID).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_first", F.coalesce(earlier, F.lit(0)) + lookup([begin.get(b, 0) for b in range(max(begin) + 1)], "_bucket")).drop("_n")
    placed = laid.join(sizes, [PID, "_bucket"]).withColumn("_place", F.col("_first") + F.col(AT) - F.col("_from"))
    return with_bound_pid(placed, "_place", bounds).drop(PID, AT, "_from", "_first", "_place")


def _cut_sort(df: DataFrame, spec: SortSpec, partitions: int | None, eps: float, samples: int, seed: int, metrics: SortMetrics | None) -> DataFrame:
    p, m, done = partitions or default_partitions(df), metrics or SortMetrics(), Search()
    with m.phase("splitters"):
        found = boundaries(df, spec, p, eps, samples, seed, done)
    m.add("rounds", done.rounds)
    m.add("pivots", done.pivots)
    with m.phase("exchange"):
        return to_partition(with_cut_pid(df, spec, found), "pid", p, spec)


def histogram_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None, eps: float = 0.1, seed: int = 1, metrics: SortMetrics | None = None) -> DataFrame:
    """Cuts by histograms over samples of the ranges still open; needs ties for a bound."""
    return _cut_sort(df, spec, partitions, eps, 5, seed, metrics)


def select_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None, eps: float = 0.1, seed: int = 1, metrics: SortMetrics | None = None) -> DataFrame:
    """Cuts by multi-way selection with one random pivot for each open range a round."""
    return _cut_sort(df, spec, partitions, eps, 1, seed, metrics)


def balanced_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None, metrics: SortMetrics | None = None) -> DataFrame:
    """Perfectly balanced: partition i gets n / p rows, one more if i < n % p.  Adds ``rank``."""
    p, m = partitions or default_partitions(df), metrics or SortMetrics()
    with m.phase("partition"):
        r = ranked(df, spec)
    m.add("rows", r.n)
    with m.phase("exchange"):
        return to_partition(r.df.withColumn("pid", even_pid(r.n, p)), "pid", p, spec)


def rank_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None) -> DataFrame:
    """Ranks first, then blocks of ceil(n / q) ranks on the first q = 2^k <= p partitions; for
    p <= 3 everything in partition 0.  Adds ``rank``."""
    p = partitions or default_partitions(df)
    q = pow2_at_most(p) if p > 3 else 1
    r = ranked(df, spec)
    return to_partition(r.df.withColumn("pid", block_pid(-(-r.n // q))), "pid", p, spec)


def packed_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None, size: int | None = None) -> DataFrame:
    """Left-packed: partition i holds ranks [i * size, (i + 1) * size).  Adds ``rank``.

    `size` is the largest input partition unless given.
    """
    most = size or max(partition_counts(df).values(), default=1)
    r = ranked(df, spec)
    p = max(partitions or 0, -(-r.n // most), 1)
    return to_partition(r.df.withColumn("pid", block_pid(most)), "pid", p, spec)


def quick_sort(df: DataFrame, spec: SortSpec, partitions: int | None = None, robust: bool = True, seed: int = 1, metrics: SortMetrics | None = None) -> DataFrame:
    """Range exchange on the largest power of two of partitions.

    Robust: equal keys are split by their ties, or by a random number if the spec has
    none; otherwise equal keys stay together and may unbalance.  The exchange samples
    its own input, so rows need no shuffle before it.
    """
    q, m = pow2_at_most(partitions or default_partitions(df)), metrics or SortMetrics()
    m.add("partitions", q)
    with m.phase("exchange"):
        if not robust:
            out = df.repartitionByRange(q, *spec.key_orderings()).sortWithinPartitions(*spec.orderings())
        elif spec.ties:
            out = df.repartitionByRange(q, *spec.orderings()).sortWithinPartitions(*spec.orderings())
        else:
            full = SortSpec(spec.keys, (Key("_tie"),))
            out = df.withColumn("_tie", F.rand(seed)).repartitionByRange(q, *full.orderings()).sortWithinPartitions(*full.orderings()).drop("_tie")
        return out.withColumn("pid", F.spark_partition_id())


def one_each(df: DataFrame, spec: SortSpec) -> DataFrame:
    """As many partitions as rows: partition r holds the row of rank r.  Adds ``rank``."""
    r = small_rank(df, spec).withColumn("pid", F.col("rank").cast("int"))
    return to_partition(r, "pid", max(df.count(), 1), spec)


def merge_bitonic(falling: DataFrame, rising: DataFrame, spec: SortSpec, partitions: int | None = None, size: int | None = None, increasing: bool = True) -> DataFrame:
    """A decreasing and an increasing run as one sorted sequence, left-packed.

    Not increasing: partitions decrease from one to the next, rows within one increase.
    Any two runs will do: that they are bitonic saves a message-passing merge steps, not this.
    """
    both = falling.unionByName(rising)
    if increasing:
        return packed_sort(both, spec, partitions, size)
    out = packed_sort(both, reversed_spec(spec), partitions, size)
    return out.sortWithinPartitions(*spec.orderings())


@dataclass
class Sorter:
    """A reusable sorter: one spec, one number of partitions, metrics of the last run.

    It places rows by rank in one step, so its ``depth`` is 1 wherever rows have to move.
    """

    spec: SortSpec
    partitions: int | None = None
    seed: int = 1
    metrics: SortMetrics = field(default_factory=SortMetrics)

    def sort(self, df: DataFrame) -> DataFrame:
        """Exactly balanced order."""
        self.metrics = SortMetrics()
        with self.metrics.phase("total"):
            return balanced_sort(df, self.spec, self.partitions, self.metrics)

    @property
    def timers(self) -> dict[str, float]:
        """Seconds of each phase of the last run, as far as it has run on the driver."""
        return dict(self.metrics.seconds)

    @property
    def depth(self) -> int:
        return int((self.partitions or 2) > 1)

    def sort_range(self, df: DataFrame, first: int, count: int) -> DataFrame:
        """Rows of ranks [first, first + count), evenly over the partitions."""
        p = self.partitions or default_partitions(df)
        with self.metrics.phase("range"):
            part = ranked(df, self.spec).df.filter(F.col("rank").between(first, first + count - 1))
            n = part.count()
            at = part.withColumn("_rank", F.col("rank")).withColumn("rank", F.col("rank") - first)
            placed = at.withColumn("pid", even_pid(n, p)).withColumn("rank", F.col("_rank")).drop("_rank")
            return to_partition(placed, "pid", p, self.spec)
