"""Checks of what the sorters promise: order, completeness, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.spec import SortSpec


def is_sorted(df: DataFrame, spec: SortSpec) -> bool:
    """Whether the partitions are sorted, and no partition begins before an earlier one ends.

    Only the first and last row of each partition travel to the driver.
    """
    laid = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    key = [F.expr(k.expr).alias(f"_k{i}") for i, k in enumerate(spec.keys)]
    rows = laid.select("_p", "_i", *key)
    by_place = Window.partitionBy("_p").orderBy("_i")
    flat = SortSpec(tuple(type(k)(f"_k{i}", k.ascending, k.nulls_first) for i, k in enumerate(spec.keys)))
    before = rows.select("*", *[F.lag(f"_k{i}").over(by_place).alias(f"_b{i}") for i in range(len(key))], F.lag("_i").over(by_place).alias("_before"))
    if not before.filter(F.col("_before").isNotNull() & _less(flat, "_k", "_b")).isEmpty():
        return False
    ends = rows.groupBy("_p").agg(F.min_by(F.struct(*[f"_k{i}" for i in range(len(key))]), "_i").alias("a"), F.max_by(F.struct(*[f"_k{i}" for i in range(len(key))]), "_i").alias("b"))
    ends = ends.withColumn("prev", F.lag("b").over(Window.orderBy("_p")))  # one row a partition
    ends = ends.filter("prev is not null").select(*[F.col(f"a._k{i}").alias(f"_k{i}") for i in range(len(key))], *[F.col(f"prev._k{i}").alias(f"_b{i}") for i in range(len(key))])
    return ends.filter(_less(flat, "_k", "_b")).isEmpty()


def _less(spec: SortSpec, a: str, b: str) -> Column:
    """Whether the columns a0, a1, ... come strictly before b0, b1, ..."""
    out = F.lit(False)
    for i, k in reversed(list(enumerate(spec.keys))):
        x, y = F.col(f"{a}{i}"), F.col(f"{b}{i}")
        less = F.when(x.isNull() & y.isNull(), False).when(x.isNull(), k.nulls_lead).when(y.isNull(), not k.nulls_lead).otherwise(x < y if k.ascending else x > y)
        out = less | (x.eqNullSafe(y) & out)
    return out


def nothing_lost(before: DataFrame, after: DataFrame) -> bool:
    """Whether both hold the same rows equally often, in one aggregation of each."""
    columns = before.columns
    count = lambda df, sign: df.select(*columns).groupBy(*columns).agg(F.sum(F.lit(sign)).alias("_n"))
    both = count(before, 1).unionByName(count(after, -1))
    return both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").isEmpty()


def loads(df: DataFrame, partitions: int | None = None) -> list[int]:
    """Rows of each partition, empty ones included."""
    counts = {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    n = partitions if partitions is not None else max(counts, default=-1) + 1
    return [counts.get(k, 0) for k in range(max(n, max(counts, default=-1) + 1))]


def imbalance(df: DataFrame, partitions: int) -> float:
    """Largest load over the even one."""
    sizes = loads(df, partitions)
    total = sum(sizes)
    return max(sizes, default=0) / (-(-total // partitions)) if total else 1.0


def covers(ranges: list[tuple[int, int]], n: int) -> bool:
    """Whether ranges [from, to) cover 0 .. n-1 once each."""
    at = 0
    for a, b in sorted(r for r in ranges if r[1] > r[0]):
        if a != at:
            return False
        at = b
    return at == n
