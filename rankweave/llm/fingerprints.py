"""Document fingerprints by winnowing, in DataFrame operations only.

Words are hashed, and the hashes of overlapping k-grams (k = 5 words) are rolled
up from those of the shorter grams inside them.  In every window of w = 8
consecutive k-grams the smallest hash is chosen, the rightmost among equal ones,
with its position.  Two texts that share w + k - 1 = 12 consecutive words
therefore share a fingerprint, and the positions tell where.

A fingerprint entry is one long: 37 bits of hash above 26 bits that order equal
hashes from right to left.  The smallest entry of a window is thus found by
``least`` over arrays shifted against each other.

Defined results: null and empty texts and texts of white space have no entries;
fewer than k words make one gram of all words, fewer than w grams one window.
Two empty fingerprints are alike (1), an empty and another are not (0).  Rows without
doc_id come after all others; rows of one doc_id, or without one, follow each other in
order of a hash of their text; a single row is its own next document; an empty table
gives an empty one, and other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.llm.mixing import WORDS, ranges
from rankweave.llm.storage import written
from rankweave.operators.cutsearch import with_place
from rankweave.spec import SortSpec

GRAM, WINDOW = 5, 8
_PLACE = 26
_LAST = (1 << _PLACE) - 1
#: Rows that one cell of neighbouring documents is meant to hold, and the most cells: their
#: list, of 40 bytes each, goes to all tasks.  Beyond, cells grow, and are sorted on disk.
CELL_ROWS, CELLS = 4000, 20_000
#: Bytes of text that one task is meant to get.
TASK_BYTES = 64 << 20


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with `value` computed once."""
    return F.transform(F.array(value), f)[0]


def _shifted(x: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(x[i], x[i + by]) for every i; null stands in past the end."""
    return _let(x, lambda a: F.zip_with(a, F.slice(a, F.lit(by + 1), F.greatest(F.size(a), F.lit(1))), f))


def grams(words: Column) -> Column:
    """Hashes of all 5-grams of an array of words: 2-grams, from them 4-grams, from them 5-grams."""

    def five(h: Column) -> Column:
        four = _shifted(_shifted(h, 1, lambda a, b: F.xxhash64(a, b)), 2, lambda a, b: F.xxhash64(a, b))
        rolled = F.zip_with(four, F.slice(h, F.lit(GRAM), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        return F.slice(rolled, F.lit(1), F.greatest(F.size(h) - (GRAM - 1), F.lit(1)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), five)


def winnow(hashes: Column) -> Column:
    """Entries chosen from the windows over an array of hashes, in order of position."""
    entry = F.transform(
        hashes,
        lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 37), _PLACE).bitwiseOR(F.lit(_LAST).cast("long") - i.cast("long").bitwiseAND(F.lit(_LAST))),
    )
    least = lambda a, b: F.least(a, b)
    lowest = _shifted(_shifted(_shifted(entry, 1, least), 2, least), 4, least)
    return _let(lowest, lambda m: F.array_distinct(F.slice(m, F.lit(1), F.greatest(F.size(m) - (WINDOW - 1), F.lit(1)))))


def fingerprint(text: Column) -> Column:
    """Array of the entries of a text."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORDS})"), F.lit(1))
    return _let(words, lambda w: F.when(F.size(w) > 0, winnow(grams(w))).otherwise(F.array().cast("array<bigint>")))


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, _PLACE)


def position_of(entry: Column) -> Column:
    """The word at which the chosen k-gram begins."""
    return F.lit(_LAST) - entry.bitwiseAND(F.lit(_LAST))


def as_text(entries: Column) -> Column:
    """hash:position, joined by blanks."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lower(F.hex(hash_of(e))), F.lit(":"), position_of(e).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either fingerprint that both have."""
    hashes = lambda x: F.array_distinct(F.transform(x, hash_of))
    both = F.size(F.array_intersect(hashes(a), hashes(b))).cast("double")
    either = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, text: Column, value: Column) -> DataFrame:
    """doc_id, v (`value`, a struct) and next_v: that of the next document in descending
    order of doc_id, and of the first after the last.

    Documents are dealt into cells of neighbouring ids, cut at quantiles of the ids; the
    first document of each cell is also sent to the cell before it, whose last document it
    follows.  Rows without doc_id are dealt into cells of their own by a hash.
    """
    seen = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.sum(F.octet_length(text)).alias("bytes")).first()
    cuts = ranges(docs, "doc_id", seen.n, CELL_ROWS, CELLS)
    spare = max(1, min(CELLS, seen.none // CELL_ROWS))
    given = with_place(docs.select("doc_id", text.alias("_text")), SortSpec.by("doc_id").keys, cuts, "_cell").withColumn("_h", F.xxhash64("_text"))
    given = given.withColumn("cell", F.when(F.col("doc_id").isNull(), -1 - F.pmod("_h", F.lit(spare))).otherwise(F.col("_cell")).cast("long"))
    # the first of a cell: greatest id, of these the least hash
    firsts = given.groupBy("cell").agg(F.max(F.struct("doc_id", (-F.col("_h").cast("decimal(20,0)")).alias("h"))).alias("m"))
    ahead = Window.orderBy(F.col("cell").asc())  # one row a cell
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    # the cell above; the first of the topmost cell follows the last of the bottommost
    above = F.when(F.col("cell") == F.max("cell").over(whole), F.min("cell").over(whole)).otherwise(F.lead("cell").over(ahead))
    firsts = written(firsts.select("cell", F.col("m.doc_id").alias("first_id"), (-F.col("m.h")).cast("long").alias("first_h"), above.alias("above")), "cells")
    rows = given.withColumn("v", value).join(F.broadcast(firsts), "cell")
    own = F.struct(F.col("cell").alias("cell"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("above").alias("cell"), F.lit(True).alias("guest"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("_h") == F.col("first_h"))
    rows = rows.select("doc_id", "_h", "v", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("doc_id", "_h", "v", "at.cell", "at.guest").repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(seen.bytes or 0) // TASK_BYTES), "cell")
    order = Window.partitionBy("cell").orderBy("guest", F.col("doc_id").desc(), "_h")
    return rows.withColumn("next_v", F.lead("v").over(order)).filter(~F.col("guest")).select("doc_id", "v", "next_v")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the latter
    and to the next document's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next(docs, text, F.struct(F.col("_text").alias("text"), fingerprint(F.col("_text")).alias("fp")))
    n = F.length("v.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("v.text"), F.lit(1), n - half), F.substring(F.col("next_v.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("v.fp").alias("fp"), F.col("next_v.fp").alias("next_fp"))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        F.col("doc_id").cast("long"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
