"""Pivots: medians of samples, and of trees of medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankweave.functions import whole
from rankweave.operators.rank import small_rank
from rankweave.operators.sampling import uniform
from rankweave.plans.levels import pivot_samples, ternary_levels
from rankweave.spec import SortSpec


def ternary_median(df: DataFrame, place: str, value: str) -> DataFrame:
    """A pivot by a tree of medians of three, as ``median``: of the values at places 0 ..
    3 ** e - 1, the largest such power, each three neighbours give their median to the next level."""
    sizes = ternary_levels(df.count())
    held = df.filter(F.col(place) < (sizes[0] if sizes else 0)).select(F.col(place).cast("long").alias("i"), F.col(value).alias("median"))
    for _ in sizes[1:]:
        held = held.groupBy(whole(F.col("i"), 3).alias("i")).agg(F.sort_array(F.collect_list("median"))[1].alias("median"))  # three a group
    return held.select("median")


def sample_pivot(df: DataFrame, spec: SortSpec, partitions: int, seed: int, least: int = 64) -> DataFrame:
    """The median row (keys and ties) of a uniform sample of the size that suits `partitions`,
    as _k0, _k1, ...; equal keys are told apart by the ties, so they can't unbalance a split."""
    n = df.count()
    wanted = pivot_samples(n, partitions, least)
    if wanted < 0:
        return df.select(*spec.values()).limit(0)
    drawn = uniform(df.select(*spec.values()), wanted, seed)
    return small_rank(drawn, spec.flat()).filter(F.col("rank") == wanted // 2).drop("rank")
