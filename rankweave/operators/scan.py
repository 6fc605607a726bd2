"""Prefix operations over ordered DataFrames without a window over one partition.

A global prefix is taken in two steps.  Rows are range partitioned and sorted, and
the prefix is taken within each partition; the partitions' totals - one row each -
are scanned and added back.  Only that little table is ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.spec import SortSpec

_LOCAL = (1 << 33) - 1
PID, AT = "_pid", "_at"


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, spec: SortSpec, partitions: int | None = None) -> DataFrame:
    """The rows in global order: partition ``_pid`` by partition, at place ``_at`` within each.

    Persisted, because both columns describe one physical layout that several jobs
    rely on; a lost executor's part is rebuilt from the same range boundaries.
    """
    n = partitions or default_partitions(df)
    ranged = df.repartitionByRange(n, *spec.orderings()).sortWithinPartitions(*spec.orderings())
    laid = ranged.withColumn(PID, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))
    return kept(laid)


_KEPT: list[list[DataFrame]] = []


def kept(df: DataFrame) -> DataFrame:
    """Persist a layout that several jobs rely on; ``layouts`` lets it go."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _KEPT:
        _KEPT[-1].append(held)
    return held


@contextmanager
def layouts() -> Iterator[None]:
    """Layouts persisted inside are released at the end, when their results must have been used."""
    _KEPT.append([])
    try:
        yield
    finally:
        for df in _KEPT.pop():
            df.unpersist()


def partition_counts(df: DataFrame, pid: str | None = None) -> dict[int, int]:
    """Rows of each partition that has any; by the column `pid` or the physical partition."""
    key = F.col(pid) if pid else F.spark_partition_id()
    return {r.p: r.n for r in df.groupBy(key.alias("p")).agg(F.count("*").alias("n")).collect()}


def exclusive(values: dict[int, int]) -> dict[int, int]:
    """Sum of the values of smaller keys."""
    out, total = {}, 0
    for k in sorted(values):
        out[k] = total
        total += values[k]
    return out


def _carry(df: DataFrame, offsets: dict[int, object], name: str, kind: str) -> DataFrame:
    """Adds each partition's offset as a column; one row a partition, never more, is sent to all tasks."""
    table = df.sparkSession.createDataFrame([(int(k), v) for k, v in offsets.items()], f"{PID} int, `{name}` {kind}")
    return df.join(F.broadcast(table), PID, "left")


def running_total(df: DataFrame, spec: SortSpec, value: str, partitions: int | None = None) -> DataFrame:
    """Adds ``exscan`` (sum of `value` over earlier rows), ``scan`` (with the row) and ``total``."""
    laid = in_order(df, spec, partitions)
    before = Window.partitionBy(PID).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    sums = {r[PID]: r.s or 0 for r in laid.groupBy(PID).agg(F.sum(value).alias("s")).collect()}
    local = laid.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    out = _carry(local, exclusive(sums), "_base", local.schema["_local"].dataType.simpleString())
    out = out.withColumn("exscan", F.col("_base") + F.col("_local")).withColumn("scan", F.col("exscan") + F.coalesce(F.col(value), F.lit(0)))
    return out.withColumn("total", F.lit(sum(sums.values())).cast(local.schema["_local"].dataType)).drop(PID, AT, "_local", "_base")


def last_flagged(df: DataFrame, spec: SortSpec, flag: Column, value: str, partitions: int | None = None) -> DataFrame:
    """Adds ``prev_flagged``: `value` of the nearest earlier row with `flag`, else the row's own."""
    laid = in_order(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), spec, partitions)
    held = F.when(F.col("_flag"), F.struct(F.col(value).alias("v")))
    before = Window.partitionBy(PID).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    last = laid.filter("_flag").groupBy(PID).agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(AT)).alias("c")).collect()
    lasts, carried, held_now = {r[PID]: r.c for r in last}, {}, None
    for p in range(1 + max(lasts, default=-1) + default_partitions(df) + (partitions or 0)):
        carried[p] = held_now
        held_now = lasts.get(p, held_now)
    out = laid.withColumn("_local", F.last(held, ignorenulls=True).over(before))
    out = _carry(out, carried, "_carried", f"struct<v: {df.schema[value].dataType.simpleString()}>")
    found = F.coalesce("_local", "_carried")
    picked = F.when(found.isNotNull(), found["v"]).otherwise(F.col(value))
    return out.withColumn("prev_flagged", picked).drop(PID, AT, "_flag", "_local", "_carried")


def grouped_scan(counts: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """Exclusive and inclusive prefix and total of `value` along `order` within each group."""
    w = Window.partitionBy(*group)
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("exscan", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return out.withColumn("scan", F.col("exscan") + F.col(value)).withColumn("total", F.sum(value).over(w))


def reduce_all(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Several aggregates over all rows in one pass: sums, extremes, bitwise and / or, counts."""
    return df.agg(*[c.alias(name) for name, c in aggregates.items()])


def fold_in_order(df: DataFrame, spec: SortSpec, value: str, combine: Callable[[Column, Column], Column], fan: int = 64) -> DataFrame:
    """One row with ``folded``: all values combined in the order of `spec` by an associative
    function, that need not commute.  Neighbours are folded `fan` at a time, level by level,
    so no task holds more than `fan` values at once."""
    laid = in_order(df, spec)
    counts = partition_counts(laid, PID)
    placed = _carry(laid, exclusive(counts), "_base", "long").select((F.col("_base") + F.col(AT)).alias("i"), F.col(value).alias("v"))
    left = sum(counts.values())
    while left > 1:
        group = F.sort_array(F.collect_list(F.struct("i", "v")))
        rest = F.slice(F.col("g"), 2, F.greatest(F.size("g") - 1, F.lit(0)))
        placed = placed.groupBy(F.floor(F.col("i") / fan).alias("at")).agg(group.alias("g"))
        placed = placed.select(F.col("at").alias("i"), F.aggregate(rest, F.col("g")[0]["v"], lambda a, x: combine(a, x["v"])).alias("v"))
        left = -(-left // fan)
    return placed.select(F.col("v").alias("folded"))
