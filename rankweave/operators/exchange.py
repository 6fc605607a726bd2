"""Exchanges: rows to partitions by number, by rank, by cuts, or at random."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankweave.functions import slot_of_rank, whole
from rankweave.operators.cutsearch import with_place
from rankweave.operators.rank import Cut
from rankweave.plans.levels import pow2_at_most
from rankweave.spec import SortSpec


def to_partition(df: DataFrame, pid: str, partitions: int, spec: SortSpec | None = None) -> DataFrame:
    """One shuffle that sends each row to the partition that column `pid` names, then sorts there."""
    out = df.repartitionById(partitions, F.col(pid).cast("int"))
    return out if spec is None else out.sortWithinPartitions(*spec.orderings())


def even_pid(n: int, partitions: int) -> Column:
    """Partition of ``rank`` if all get n / partitions rows, the first ones one more."""
    return slot_of_rank(F.col("rank"), n, partitions)


def block_pid(rows: int) -> Column:
    """Partition of ``rank`` if each holds `rows` ranks."""
    return whole(F.col("rank"), max(rows, 1)).cast("int")


def with_cut_pid(df: DataFrame, spec: SortSpec, cuts: Sequence[Cut], name: str = "pid") -> DataFrame:
    """Adds the partition of each row between cuts: how many cuts it is not before."""
    real = [c.at for c in cuts if c.at is not None]  # cuts at the end come last and hold no rows back
    return with_place(df, spec.total, real, name)


def with_bound_pid(df: DataFrame, position: str, bounds: Sequence[int], name: str = "pid") -> DataFrame:
    """Adds the partition of each global position between ascending bounds."""
    return with_place(df, SortSpec.by(position).keys, [(b,) for b in bounds], name)


def even_in_group(df: DataFrame, group: str, rank: str, sizes: DataFrame, slots: str, n: str) -> DataFrame:
    """Adds ``slot``: an even split of each group's ranks over that group's slots.

    `sizes`: a row for each group with its number of slots and of rows; groups may be many.
    """
    joined = df.join(sizes, group)
    size, more = F.expr(f"`{n}` div `{slots}`"), F.col(n) % F.col(slots)
    wide = more * (size + 1)
    high = F.expr(f"(`{rank}` - (`{n}` % `{slots}`) * (`{n}` div `{slots}` + 1)) div greatest(`{n}` div `{slots}`, 1)") + more
    low = F.expr(f"`{rank}` div (`{n}` div `{slots}` + 1)")
    return joined.withColumn("slot", F.when(F.col(rank) < wide, low).otherwise(high).cast("long")).drop(slots, n)


def shuffled(df: DataFrame, partitions: int, seed: int) -> DataFrame:
    """Rows dealt to partitions at random."""
    return df.repartition(partitions, F.rand(seed))


def folded(df: DataFrame, partitions: int) -> DataFrame:
    """The rows on a power of two of partitions, without a shuffle."""
    return df.coalesce(pow2_at_most(partitions))


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition holds, and the others (null included)."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)
