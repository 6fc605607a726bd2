"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of the whole mix, at most ``cap`` times
its own size; what is over goes to the others by weight until none is above.
Within a source every document expects target / size copies.  The documents
stand in order of size and doc_id; the expected copies are summed along that
order, one offset is added, and a document is emitted once for each integer
that its stretch of the sum crosses.  So a source's copies differ by less than
one from their expectation on every stretch of the order, and no document gets
more than ``cap`` copies rounded up.

Everything is DataFrame operations.  The position of a document within its
source comes from counts: by (source, size, range of doc_id), summed over sizes
and over ranges, plus a row number within one such cell.  The ranges hold a
bounded number of rows each, so a source, or a group of equal sizes, that holds
a third of all rows is spread over many tasks.

Defined results: null text has size 0; null source is a source of its own and
comes last; a source of size 0 has target 0 and takes nothing; repeated rows
count each; rows without doc_id come first of their size, and rows of one doc_id and size
are ordered by a hash of their text; an empty table gives an empty one; with ``carry``
columns of any name are kept in ``row``.  Reruns agree: the offset is a digest of seed
and source.  The driver gets the ends of the ranges, and the sources' sums meet in one
task, one row for each source.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.llm.storage import written
from rankweave.operators.cutsearch import with_place
from rankweave.spec import SortSpec

#: Rows that one range of doc_id is meant to hold, and the most ranges; beyond, ranges grow
#: and a range's rows of one size and source are sorted on disk.
RANGE_ROWS, RANGES = 20_000, 20_000

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row for each source: source_size, target, rate (expected copies)."""
    w = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    w = w.withColumn("place", F.row_number().over(named) - 1).withColumn("weight", weight.cast("long"))
    w = w.withColumn("most", F.col("source_size") * cap)
    # Sources fill up in order of most / weight: at its turn, source k is full if its share
    # of what the fuller ones left is at least its limit.
    filling = Window.orderBy(F.col("most").cast("double") / F.col("weight").cast("double"), "place")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    total = F.sum("source_size").over(whole).cast("double") * F.lit(float(share))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")
    w = w.withColumn("level", left / F.sum("weight").over(after).cast("double"))
    full = F.col("most").cast("double") / F.col("weight").cast("double") <= F.col("level")
    w = w.withColumn("full", full)
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * level)
    w = w.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return w.select("source", "source_size", "target", rate.alias("rate"))


def _offset(seed: int) -> Column:
    """A number in [0, 1) that depends on seed and source alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assign(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 7, carry: bool = False) -> DataFrame:
    """Copies of each document: doc_id, source, size, source_size, target, copies, taken.

    With `carry` the whole rows of `docs` are kept too, in a column ``row``.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row")) if carry else None
    sized = written(sized, "sizes")
    rows = sized if rows is None else rows
    n = sized.count()
    ends = ranges(sized, "doc_id", n, RANGE_ROWS, RANGES)
    sized, rows = (with_place(x, SortSpec.by("doc_id").keys, ends, "cell") for x in (sized, rows))
    keys = ["source", "size", "cell"]
    cells = sized.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n_size"))
    of_size = of_size.withColumn("smaller", F.coalesce(F.sum("n_size").over(earlier(Window.partitionBy("source").orderBy("size"))), F.lit(0)))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("source", "size").orderBy("cell"))), F.lit(0)))
    of_size = of_size.join(_targets(sized, weights, share, cap).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n_size")
    cells = cells.drop("n").join(of_size.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    cells = cells.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), (F.col("before") + F.col("smaller")).alias("first"), "source_size", "target", "rate")
    joined = rows.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("cell") == F.col("c"))).drop("s", "z", "c")
    place = F.col("first") + F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", *[F.xxhash64("row.text")] * carry))
    crossed = lambda k: F.floor(k.cast("double") * F.col("rate") + _offset(seed))
    copies = (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("long")
    out = joined.withColumn("place", place).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("cell", "first", "place", "rate")


def ranges(df: DataFrame, column: str, n: int, rows: int, most: int) -> list[tuple[int]]:
    """Ascending ends of ranges of a column that hold about `rows` of its n values each."""
    parts = max(2, min(most, -(-n // rows)))
    shares = F.from_json(F.lit(json.dumps([k / parts for k in range(1, parts)])), "array<double>")
    return [(m,) for m in sorted(set(df.select(F.percentile_approx(column, shares, F.lit(20 * parts)).alias("m")).first().m or []))]


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each row of `docs` as often as it is taken, columns unchanged."""
    out = assign(docs, carry=True, **options).filter(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def oracle(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 7) -> str:
    """``assign`` as SQL for DuckDB."""
    picks = " ".join(f"when {k} then {w}" for k, w in enumerate(weights))
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), per_source as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source collate "binary" nulls last) - 1 as place
  from sized group by source
), limits as (
  select *, (case place % {len(weights)} {picks} end)::bigint as weight, source_size * {cap} as most from per_source
), levels as (
  select *, (sum(source_size) over ())::double * {float(share)}::double as total,
    coalesce(sum(most) over (order by most::double / weight::double, place rows between unbounded preceding and 1 preceding), 0)::double as gone,
    (sum(weight) over (order by most::double / weight::double, place rows between current row and unbounded following))::double as open
  from limits
), filled as (
  select *, (total - gone) / open as level, most::double / weight::double <= (total - gone) / open as is_full from levels
), targets as (
  select source, source_size, case when is_full then most::double else weight::double *
    (select level from filled where not is_full order by most::double / weight::double, place limit 1) end as target from filled
), placed as (
  select s.doc_id, s.source, s.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end as rate,
    row_number() over (partition by s.source order by s.size, s.doc_id nulls first) as place,
    ('0x' || substr(md5('{seed}:' || coalesce(s.source, '')), 1, 8))::bigint::double / 4294967296.0::double as shift
  from sized s join targets t on s.source is not distinct from t.source
), counted as (
  select *, (floor(place::double * rate + shift) - floor((place - 1)::double * rate + shift))::bigint as copies from placed
)
select doc_id, source, size, source_size, target, copies, copies * size as taken from counted
"""
