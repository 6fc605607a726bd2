"""Near duplicates by one-permutation MinHash, banding and star-shaped candidate links.

A document's set holds its distinct 5-word shingles (lower-case A-Z).  Documents
with equal sets form one class, and only classes are compared.

* Signature: one permutation of the shingle hashes for each band, cut into ``ROWS``
  bins; the least hash of each bin is kept.  Empty bins are filled by optimal
  densification: bin i borrows from bins drawn from a hash of (i, attempt), the same
  for all sets, until it meets a full one.  With so few bins for each permutation, and
  permutations that are independent, this holds for sets of any size.
* Bands: the number of bands follows from the threshold, so that a pair at the
  threshold shares none with a probability of at most ``MISS``.
* Stars: each bucket links its members to one centre instead of pairwise.  Every
  candidate is confirmed on the full sets.  A star may miss a pair of its leaves
  only if they lie in different components.  Buckets that still hold several
  components get ``CENTRES`` more centres, which settles those of at most one member more.
* What is left of larger mixed buckets is settled exactly: the full sets of the
  members that were no centre meet in tasks bounded in bytes, which emit only links
  that join components.

Hot classes, buckets and centres are dealt to many tasks; no step depends on how
large a group is but in the number of tasks it takes.

Defined results: null, empty and blank texts have empty sets and are linked with
nothing; fewer than five words make one shingle of the whole sequence; rows of one
doc_id with unlinked texts are documents of their own, each kept or not by its own
group; rows without doc_id are linked with nothing and kept; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankweave.llm import kernels as K
from rankweave.llm.components import ROW_BYTES, components, merged
from rankweave.llm.skew import join_spread, sizes
from rankweave.llm.storage import written

SHINGLE, ROWS, MISS = 5, 5, 1e-7
#: More centres of a bucket that mixes components; members, and bytes of full sets, in a block of what is left.
CENTRES, BLOCK, BLOCK_BYTES = 8, 512, 8 << 20


def band_count(percent: int) -> int:
    """Bands after which a pair at the threshold is missed with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, _, _, counts = K.words(data, offs, lower=True)
    grams = K.rolling(hashes, SHINGLE)
    ends = np.cumsum(counts)
    for end, n in zip(ends, counts, strict=True):
        if n >= SHINGLE:
            yield np.unique(grams[end - n : end - SHINGLE + 1])
        elif n:
            part = np.concatenate((hashes[end - n : end], np.full(SHINGLE - n, 0x51ED270B, np.uint64)))
            yield K.mix64(K.rolling(part, SHINGLE) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


class Signer:
    """Band keys of sets for one threshold."""

    def __init__(self, percent: int) -> None:
        self.bands = band_count(percent)
        rng = np.random.Generator(np.random.PCG64(11))
        self.odd = rng.integers(0, 2**63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**64, self.bands, dtype=np.uint64)
        self.borrow = rng.integers(0, ROWS, (self.bands, 64, ROWS))
        self.weights = rng.integers(0, 2**63, (self.bands, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.edges = [np.uint64(k * 2**64 // ROWS) for k in range(ROWS)]
        self.wide = [np.uint64((k + 1) * 2**64 // ROWS - k * 2**64 // ROWS) for k in range(ROWS)]

    def minima(self, elements: np.ndarray, first: np.ndarray, band: int) -> np.ndarray:
        """Least hash of each bin for the (not empty) sets that begin at `first`, empty bins densified."""
        h = elements * self.odd[band] + self.add[band]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out, full = np.empty((ROWS, len(first)), np.uint64), np.empty((ROWS, len(first)), bool)
        for k in range(ROWS):  # the first hash at or after the bin's lower edge, around the circle
            above = np.minimum.reduceat(h - self.edges[k], first)
            full[k] = above < self.wide[k]
            out[k] = above + self.edges[k]
        empty = ~full
        for attempt in self.borrow[band]:
            if not empty.any():
                break
            for k in range(ROWS):
                take = empty[k] & full[attempt[k]]
                out[k][take] = out[attempt[k]][take]
                empty[k] &= ~take
        return out

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band keys for each set, none of them empty."""
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        elements = np.concatenate(sets)
        out = np.empty((len(sets), self.bands), np.uint64)
        for band in range(self.bands):
            out[:, band] = (self.minima(elements, first, band) * self.weights[band][:, None]).sum(0, dtype=np.uint64) + np.uint64(band)
        return K.mix64(out).view(np.int64)


def _set_name(found: np.ndarray) -> bytes:
    """128 bits that name a set."""
    if not len(found):
        return b""
    a = (found * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = K.mix64(found ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(found))
    return K.mix64(np.array([a, b])).tobytes()


def signatures(docs: DataFrame, percent: int, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, class (names the set; empty for an empty set), keys (of its bands);
    and the column _digest of `docs` as digest, if asked for."""
    names = ["doc_id", "n_shingles", "class", "keys", *["digest"] * digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(percent)
        for batch in batches:
            data, offs = K.text_column(batch.column(1))
            for a, b in K.slices(data, offs):
                sets = list(shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                real = [s for s in sets if len(s)]
                keys = signer.keys(real).reshape(-1) if real else np.zeros(0, np.int64)
                at = np.concatenate(([0], np.cumsum([signer.bands * (len(s) > 0) for s in sets])))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))
                columns = [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_set_name, sets), pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([*columns, *[c.slice(a, b - a) for c in batch.columns[2:]]], names)
            del batch
            K.release()

    given = docs.select(F.col("doc_id").cast("long"), "text", *[F.col("_digest")] * digest)
    return given.mapInArrow(run, "doc_id long, n_shingles long, class binary, keys array<long>" + ", digest binary" * digest)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, elements of the wanted classes (columns: doc_id of a member, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_column(batch.column(0))
            for a, b in K.slices(data, offs):
                sets = list(shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
                yield pa.RecordBatch.from_arrays([pa.array(map(_set_name, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "elements"])
            del batch
            K.release()

    # by merge at any size: the list of wanted documents has no bound that would let all tasks have it
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(run, "class binary, elements binary")
    return sets.join(wanted.select("class").distinct().hint("merge"), "class", "left_semi").groupBy("class").agg(F.first("elements").alias("elements"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Those distinct pairs (a, b) of classes, at most `rows`, with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held, left, right = [], None, None, None
            for k in range(batch.num_rows):
                left = np.frombuffer(batch.column(2)[k].as_py(), np.uint64)
                name = batch.column(1)[k].as_py()
                if name != held:
                    held, right = name, np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(k)
            found = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            del batch, left, right
            K.release()
            yield found

    pairs = given = written(pairs, "pairs", rows * ROW_BYTES)
    for node, column, by in (("a", "left", "b"), ("b", "right", "a")):
        counts = pairs.groupBy(node).agg(F.count("*").alias("n"))
        given = join_spread(given, sets.select(F.col("class").alias(node), F.col("elements").alias(column)), node, counts, *sizes(counts), by)
    # sizes alone rule many pairs out
    n, m = F.octet_length("left"), F.octet_length("right")
    given = given.filter(F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    return given.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def link(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept, for every document."""
    return _linked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, percent: int, digest: bool = False) -> DataFrame:
    """What link() returns, class, comp (a class that names the component), and digest if asked for."""
    signed = written(signatures(docs, percent, digest), "signatures")
    n, bands = signed.count(), band_count(percent)  # bound the bytes of what follows
    once = signed.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    once = written(once, "classes", n * (ROW_BYTES + 8 * bands))
    entries = once.filter("doc_id is not null").select("class", "doc_id", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("centre")).filter("n > 1")
    shared = written(shared, "keys", n * bands // 2 * ROW_BYTES)
    buckets = join_spread(entries, shared.drop("n"), "key", shared, *sizes(shared), "class").select("key", "class", "doc_id", "centre")
    buckets = written(buckets, "buckets", n * bands * ROW_BYTES)
    members = buckets.count()
    sets = written(_full_sets(docs, buckets.select("doc_id", "class").distinct()), "sets")
    pairs = buckets.filter(F.col("class") != F.col("centre")).select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    links = written(_confirmed(pairs, sets, percent, members), "links")
    comps = written(components(links, members), "components", n * ROW_BYTES)
    mixed = _mixed(buckets, comps, members)
    if mixed is not None:
        more = written(_confirmed(_more_stars(mixed), sets, percent, CENTRES * members), "links")
        if count := more.count():
            comps = written(merged(comps, more, count), "components", n * ROW_BYTES)
        rest = _mixed(mixed.filter("n > 1 + " + str(CENTRES)).select("key", "class"), comps, members)
        if rest is not None:
            settled = written(_settled(rest, sets, percent), "links")
            comps = written(merged(comps, settled, settled.count()), "components", n * ROW_BYTES)
    of_class = once.join(comps.withColumnRenamed("node", "class").hint("merge"), "class", "left").select("class", "n", F.col("doc_id").alias("first_id"), F.coalesce("comp", "class").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    of_class = written(join_spread(of_class, least.drop("n"), "comp", least, *sizes(least), "class", merge=True).select("class", "n", "comp", "component_id"), "named", n * ROW_BYTES)
    out = signed.drop("keys")
    # rows without shingles stand for themselves and meet nowhere
    out = join_spread(out.filter("n_shingles > 0"), of_class.drop("n"), "class", of_class, *sizes(of_class), "doc_id", "left", merge=True).unionByName(
        out.filter("n_shingles = 0").withColumns({"comp": F.lit(None).cast("binary"), "component_id": F.lit(None).cast("long")})
    )
    alone = F.col("doc_id").isNull() | F.col("component_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumns({"component_id": component, "kept": F.coalesce(F.col("doc_id") == component, F.lit(True))})


def _mixed(buckets: DataFrame, comps: DataFrame, members: int) -> DataFrame | None:
    """The members of buckets (key, class), at most `members`, that hold several components, written; with comp, n
    (members of the bucket), and place: 1 .. CENTRES for those that are centres next, more for the others."""
    named = buckets.select("key", "class").join(comps.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    named = written(named, "named", members * ROW_BYTES)
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), (F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed").drop("mixed")
    mixed = written(mixed, "mixed", members // 2 * ROW_BYTES)
    total, most = sizes(mixed)
    if not total:
        return None
    inside = join_spread(named, mixed, "key", mixed, total, most, "class")
    order = Window.partitionBy("key").orderBy(F.xxhash64("class", "key"))  # each task sends on its first ones only
    first = inside.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= CENTRES).select("key", "class", "place")
    return written(inside.join(first.hint("merge"), ["key", "class"], "left").withColumn("place", F.coalesce("place", F.lit(CENTRES + 1))), "mixed", total * ROW_BYTES)


def _more_stars(mixed: DataFrame) -> DataFrame:
    """Pairs of each mixed bucket's chosen centres with the members of other components."""
    centres = mixed.filter(F.col("place") <= CENTRES).groupBy("key").agg(F.collect_list(F.struct("class", "comp", "place")).alias("centres"))
    counts = mixed.groupBy("key").agg(F.count("*").alias("n"))
    met = join_spread(mixed.drop("n"), centres, "key", counts, *sizes(counts), "class")
    met = met.select("class", "comp", "place", F.explode("centres").alias("c")).filter("comp != c.comp and place > c.place")
    return met.select(F.greatest("class", "c.class").alias("a"), F.least("class", "c.class").alias("b")).distinct()


def _settled(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that larger buckets still mix.

    The members that were no centre are cut into blocks of about BLOCK of them, or
    BLOCK_BYTES of full sets, by a hash, and each two blocks of a bucket meet in one task, which emits only links that
    join components.
    """
    left = rest.filter(F.col("place") > CENTRES).join(sets.withColumn("bytes", F.octet_length("elements")), "class")
    left = left.select("key", "class", "comp", "elements", "bytes")
    open_ = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), (F.min("comp") != F.max("comp")).alias("open")).filter("open")
    open_ = open_.select("key", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    open_ = written(open_, "sizes")
    spread = join_spread(left.drop("bytes"), open_.drop("n"), "key", open_, *sizes(open_), "class").withColumn("block", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = spread.select("*", other.alias("other")).select("key", "class", "comp", "elements", F.least("block", "other").alias("block_i"), F.greatest("block", "other").alias("block_j"))

    def run(table: pa.Table) -> pa.Table:
        a, b = _block_links(table.column("class").to_pylist(), table.column("comp").to_pylist(), [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()], percent)
        K.release()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("key", "block_i", "block_j").applyInArrow(run, "a binary, b binary")


def _block_links(names: list[bytes], comps: list[bytes], sets: list[np.ndarray], percent: int, columns: int = 2048) -> tuple[list[bytes], list[bytes]]:
    """Links that join the components of some sets, enough of them to connect what is linked.

    All intersections at once: products of 0/1 matrices over the elements that two
    sets at least have, a few thousand columns at a time.
    """
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    row, column = row[keep], (np.cumsum(often > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        part = np.zeros((len(sets), min(columns, width - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += (part @ part.T).astype(np.int64)  # exact: at most `columns`
    union = n[:, None] + n[None, :] - both
    near = np.argwhere(np.triu(100 * both >= percent * union, 1))
    root = {c: c for c in comps}

    def top(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out_a, out_b = [], []
    for i, j in near:
        x, y = top(comps[i]), top(comps[j])
        if x != y:
            root[x] = y
            out_a.append(names[i])
            out_b.append(names[j])
    return out_a, out_b


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Of a group's rows with that doc_id the one of least class, then digest of the text
    stays, and of rows equal in these the first by its other columns as JSON.
    """
    named = docs.withColumn("_digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = _linked(named, percent, digest=True).filter("kept and doc_id is not null")
    kept = rows.groupBy("doc_id", "comp").agg(F.min(F.struct("class", "digest"))["digest"].alias("_digest")).select("doc_id", "_digest")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("text").isNull().alias("a"), *[F.to_json(F.struct(*others)).alias("b")] * bool(others))
    given = named.join(kept.hint("merge"), ["doc_id", "_digest"], "left_semi").select("doc_id", "_digest", order.alias("order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = given.groupBy("doc_id", "_digest").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return once.unionByName(docs.filter("doc_id is null"))
