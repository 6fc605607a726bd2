"""Merging ordered inputs, the least and greatest of them, and bitonic sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankweave.operators.rank import global_rank
from rankweave.operators.scan import last_flagged, running_total
from rankweave.spec import Key, SortSpec


def merge_runs(runs: list[DataFrame], spec: SortSpec, partitions: int | None = None) -> DataFrame:
    """All rows of the runs with ``source`` (0, 1, ...) and their ``rank``; equal keys go by source."""
    tagged = [df.withColumn("source", F.lit(k)) for k, df in enumerate(runs)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return global_rank(both, SortSpec(spec.keys, (Key("source"), *spec.ties)), partitions)


def first_of(runs: list[DataFrame], spec: SortSpec, count: int) -> DataFrame:
    """The `count` least rows of the runs, as a top-k that never sorts them all."""
    both = reduce(lambda a, b: a.unionByName(b), runs)
    return both.orderBy(*spec.orderings()).limit(count)


def last_of(runs: list[DataFrame], spec: SortSpec, count: int) -> DataFrame:
    """The `count` greatest rows."""
    return first_of(runs, reversed_spec(spec), count)


def reversed_spec(spec: SortSpec) -> SortSpec:
    turn = lambda ks: tuple(Key(k.expr, not k.ascending, not k.nulls_lead) for k in ks)
    return SortSpec(turn(spec.keys), turn(spec.ties))


def merged_everywhere(df: DataFrame, spec: SortSpec, most: int = 100_000) -> list[tuple]:
    """A small input in order on the driver, for sending to all tasks; refuses a larger one."""
    rows = df.orderBy(*spec.orderings()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [tuple(r) for r in rows]


def is_bitonic(df: DataFrame, position: Column, spec: SortSpec) -> bool:
    """Whether the parts, in order of position, first decrease and then increase.

    A part is all rows of one position; parts may touch in equal keys.
    """
    keys = F.struct(*[F.expr(k.expr) for k in spec.keys])
    parts = df.groupBy(position.alias("p")).agg(F.min(keys).alias("low"), F.max(keys).alias("high"))
    return bool(turns(parts).first().bitonic)


def turns(parts: DataFrame) -> DataFrame:
    """``bitonic``: whether intervals (p, low, high) first fall and then rise with p.

    Two neighbours fall, rise, touch (both), or overlap (neither).  The neighbour of each
    part is found in a range layout, so no window takes all of them; what goes on from
    there is the last place that falls and the first that rises.
    """
    pairs = last_flagged(parts.withColumn("span", F.struct("low", "high")), SortSpec.by("p"), F.lit(True), "span")
    first = parts.agg(F.min("p").alias("first")).first().first
    if first is None:
        return parts.sparkSession.range(1).select(F.lit(True).alias("bitonic"))
    pairs = pairs.filter(F.col("p") != F.lit(first))
    up, down = F.col("prev_flagged.high") <= F.col("low"), F.col("prev_flagged.low") >= F.col("high")
    return pairs.agg(
        (F.coalesce(~F.bool_or(~up & ~down), F.lit(True)) & F.coalesce(F.max(F.when(down & ~up, F.col("p"))) < F.min(F.when(up & ~down, F.col("p"))), F.lit(True))).alias("bitonic")
    )


def stripe_overlaps(x: DataFrame, y: DataFrame, x_id: str, y_id: str, x_size: str, y_size: str) -> DataFrame:
    """Two tables of sizes, each laid out along one line in order of its id: (x, y, size) of
    every overlap.

    The ends of the stripes of both are put in order; between two neighbouring ends
    lies a piece of one stripe of each, found as the nearest begin before it.  So the
    join costs a sort of the ends, however many stripes there are.
    """
    ends = []
    for df, i, size, name in ((x, x_id, x_size, "x"), (y, y_id, y_size, "y")):
        laid = running_total(df.select(F.col(i).alias("id"), F.col(size).cast("long").alias("size")).filter("size > 0"), SortSpec.by("id"), "size")
        ends.append(laid.select(F.col("exscan").alias("at"), F.lit(name).alias("side"), F.col("id")))
        ends.append(laid.agg(F.max("scan").alias("at")).select("at", F.lit(f"end {name}").alias("side"), F.lit(None).alias("id")))
    points = reduce(lambda a, b: a.unionByName(b), ends)
    points = points.filter("at is not null").groupBy("at").agg(
        F.max(F.when(F.col("side") == "x", F.struct("id"))).alias("sx"),
        F.max(F.when(F.col("side") == "y", F.struct("id"))).alias("sy"),
        F.max(F.when(F.col("side") == "end x", F.lit(True))).alias("ex"),
        F.max(F.when(F.col("side") == "end y", F.lit(True))).alias("ey"),
    )
    order = SortSpec.by("at")
    points = last_flagged(points, order, F.col("sx").isNotNull(), "sx").withColumn("x", F.coalesce(F.col("sx.id"), F.col("prev_flagged.id"))).drop("prev_flagged")
    points = last_flagged(points, order, F.col("sy").isNotNull(), "sy").withColumn("y", F.coalesce(F.col("sy.id"), F.col("prev_flagged.id"))).drop("prev_flagged")
    # the piece from each point to the next one
    steps = last_flagged(points, reversed_spec(order), F.lit(True), "at")
    stop = points.agg(F.min(F.when(F.col("ex") | F.col("ey"), F.col("at")))).first()[0]
    pieces = steps.filter(F.col("at") < (0 if stop is None else stop))
    return pieces.select("x", "y", (F.col("prev_flagged") - F.col("at")).alias("size"))
