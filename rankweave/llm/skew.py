"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that count as hot are at most this many, so their list can go to all tasks.
HOT_KEYS = 100_000
#: Rows of one key that one task may get in any case.
ROWS = 500


def hot_limit(total: int) -> int:
    """Rows of a key from which it is hot: so many that no more than HOT_KEYS of `total` rows' keys are."""
    return max(ROWS, total // HOT_KEYS)


def join_spread(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, most: int, by: str, how: str = "inner", merge: bool = False) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key), the rows of hot keys dealt to many tasks.

    `counts`: key and n, the rows that each key has; `total` in all and `most` of one key
    (without a hot one the join is a plain one); `by`: SQL that tells the rows of one key
    apart.  A hot key's row of the table is copied once for each of its parts, which are at
    most twice HOT_KEYS over all keys; the list of hot keys is bounded by HOT_KEYS and sent
    to all tasks.

    An executor holds a broadcast list until the driver collects its garbage; one with a
    binary key takes a memory page (16 MB on executors of 3 GB) however short it is, one with
    a long key its own size.  So hot keys are told by a hash, and keys of one hash get equally
    many parts, which changes no row.  With `merge` no table is broadcast for being small:
    for joins by a binary key that move no large table, in loops above all, which would pile
    such pages up.
    """
    limit = hot_limit(total)
    by_merge = lambda df: df.hint("merge") if merge else df
    if most <= limit:
        return rows.join(by_merge(table), key, how)
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hot = counts.filter(F.col("n") > limit).groupBy(F.xxhash64(key).alias("_hot")).agg(F.max(parts).alias("_parts"))
    same = F.xxhash64(key) == F.col("_hot")
    spread = rows.join(F.broadcast(hot), same, "left").withColumn("_part", F.coalesce(F.expr(f"cast(pmod(xxhash64({by}), _parts) as int)"), F.lit(0)))
    copies = table.join(F.broadcast(hot), same, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return spread.drop("_hot", "_parts").join(by_merge(copies.drop("_hot", "_parts")), [key, "_part"], how).drop("_part")


def sizes(counts: DataFrame) -> tuple[int, int]:
    """Rows in all, and of the key that has most, from a table with n for each key."""
    told = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return told.total or 0, told.most or 0
