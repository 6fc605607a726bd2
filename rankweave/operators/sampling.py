"""Sampling with exact totals or given probabilities; all of it repeatable by seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rankweave.operators.rank import Ranked
from rankweave.operators.scan import AT, PID, _carry, kept, partition_counts
from rankweave.plans.levels import multinomial_quota


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with their partition and place, persisted so that both stay as they are."""
    place = F.monotonically_increasing_id()
    return kept(df.withColumn(PID, F.spark_partition_id()).withColumn(AT, place.bitwiseAND(F.lit((1 << 33) - 1))))


def uniform(df: DataFrame, total: int, seed: int, within: int | None = None) -> DataFrame:
    """Exactly `total` rows drawn with replacement; none from an empty input.

    How many each partition gives follows from one multinomial draw over the
    partitions' sizes.  With `within`, places are drawn below that number in every
    partition and those past a partition's end are dropped.  ``draws`` copies of a
    row are returned as rows.
    """
    rows = _numbered(df)
    counts = partition_counts(rows, PID)
    parts = sorted(counts)
    quota = multinomial_quota([counts[p] for p in parts], total, seed)
    table = df.sparkSession.createDataFrame([(int(p), int(q), within or counts[p]) for p, q in zip(parts, quota, strict=True)], f"{PID} int, _quota int, _size long")
    # the draws themselves are made in the executors, from one row a partition
    draws = table.filter("_quota > 0").repartition(PID).select(PID, "_size", F.explode(F.sequence(F.lit(1), "_quota")).alias("_draw"))
    spot = (F.pmod(F.xxhash64(F.lit(seed), PID, "_draw"), F.lit(1 << 53)).cast("double") / float(1 << 53) * F.col("_size")).cast("long")
    picks = draws.select(PID, spot.alias(AT)).groupBy(PID, AT).agg(F.count("*").cast("int").alias("_draws"))
    drawn = rows.join(picks, [PID, AT])
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_draws"))).select(*df.columns)


def quotas(df: DataFrame, total: int, seed: int, part: Column | None = None) -> DataFrame:
    """part, cnt, quota, exscan: a multinomial draw of `total` samples over the parts' sizes."""
    key = part if part is not None else F.spark_partition_id()
    counts = sorted((r.p, r.n) for r in df.groupBy(key.alias("p")).agg(F.count("*").alias("n")).collect())
    quota = multinomial_quota([n for _, n in counts], total, seed)
    before = np.concatenate(([0], np.cumsum(quota)[:-1])) if quota else []
    rows = [(p, int(n), int(q), int(b)) for (p, n), q, b in zip(counts, quota, before, strict=True)]
    kind = df.select(key.alias("p")).schema["p"].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"part {kind}, cnt long, quota long, exscan long")


def bernoulli(df: DataFrame, probability: float, seed: int, windows: Column | None = None) -> DataFrame:
    """Each row (inside the windows) with the given probability; all of them from 1 upwards."""
    inside = df if windows is None else df.filter(windows)
    return inside if probability >= 1 else inside.filter(F.rand(seed) < probability)


def one_of_each_range(ranked: Ranked, ranges: list[tuple[int, int]], seed: int) -> DataFrame:
    """One uniformly random row of each non-empty range [from, to) of ranks."""
    rng = np.random.Generator(np.random.PCG64(seed))
    picks = sorted({int(rng.integers(a, b)) for a, b in ranges if b > a})
    return ranked.df.filter(F.col("rank").isin(picks))


def with_tie(df: DataFrame) -> DataFrame:
    """Adds ``gid``: partition in the upper bits, place in the lower; tells equal rows apart."""
    return df.withColumn("gid", F.monotonically_increasing_id())


def carried(df: DataFrame, offsets: dict[int, int], name: str) -> DataFrame:
    """A column with a number for each partition of a numbered frame."""
    return _carry(df, offsets, name, "long")
