"""Splitters from samples, buckets between them, and histograms of buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankweave.operators.cutsearch import with_place
from rankweave.operators.rank import ranked
from rankweave.operators.scan import grouped_scan
from rankweave.spec import Key, SortSpec


def splitter_ranks(samples: int, splitters: int) -> list[int]:
    """Ranks floor(i * samples / (splitters + 1)), i = 1 .. splitters, among the samples."""
    return [i * samples // (splitters + 1) for i in range(1, splitters + 1)]


def equidistant(df: DataFrame, spec: SortSpec, splitters: int) -> DataFrame:
    """The rows at the splitter ranks, with ``i`` (1-based) and ``rank``."""
    ranked_rows = ranked(df, spec)
    ranks = splitter_ranks(ranked_rows.n, splitters)
    table = df.sparkSession.createDataFrame([(i + 1, r) for i, r in enumerate(ranks)], "i int, rank long")
    return ranked_rows.df.join(table, "rank")


def distinct_splitters(splitters: DataFrame) -> DataFrame:
    return splitters.distinct()


def sampled_splitters(df: DataFrame, spec: SortSpec, samples: int, splitters: int, seed: int) -> list[tuple]:
    """Distinct splitters (keys and ties), ascending, from about `samples` sampled rows.

    If the samples asked for reach the number of rows, all rows are samples.
    """
    n = df.count()
    drawn = df.select(*spec.values())
    drawn = drawn if samples >= n else drawn.filter(F.rand(seed) < samples / max(n, 1))
    rows = sorted((tuple(r) for r in drawn.collect()), key=spec.sort_key())  # bounded by `samples`
    out: list[tuple] = []
    for r in splitter_ranks(len(rows), splitters):
        if r < len(rows) and (not out or out[-1] != rows[r]):
            out.append(rows[r])
    return out


def with_bucket(df: DataFrame, keys: Sequence[Key], splitters: Sequence[tuple], equal_buckets: bool = True, name: str = "bucket") -> DataFrame:
    """Adds the bucket of each row between distinct ascending splitters.

    With equal buckets, 2s + 1 of them: the odd ones hold the rows equal to a
    splitter.  Without, s + 1: a row equal to a splitter lies above it.
    """
    if not equal_buckets:
        return with_place(df, keys, splitters, name)
    out = with_place(df, keys, splitters, "__bucket", same="__equal")
    return out.withColumn(name, F.col("__bucket") * 2 - F.col("__equal").cast("int")).drop("__bucket", "__equal")


def histogram(df: DataFrame, bucket: str | Column = "bucket") -> DataFrame:
    """bucket, cnt over all rows."""
    return df.groupBy((F.col(bucket) if isinstance(bucket, str) else bucket).alias("bucket")).agg(F.count("*").alias("cnt"))


def partition_histogram(df: DataFrame, part: Column, bucket: str = "bucket") -> DataFrame:
    """part, bucket, cnt with the exclusive and inclusive prefix over parts and the bucket's total."""
    counts = df.groupBy(part.alias("part"), F.col(bucket).alias("bucket")).agg(F.count("*").alias("cnt"))
    return grouped_scan(counts, ["bucket"], "part", "cnt")
