"""Removal of repeated passages by prefix-partitioned suffix trees.

Text is words; a suffix is read for ``DEPTH`` words, so trees are truncated there
and their deep internal nodes are the passages of that length that repeat.  A longer
maximal repeat is a chain of such nodes, one for each of its suffixes: neighbouring
passages of a document that all lie below deep nodes are put together into one stretch.

1. Each block of documents asks which of its passages occur anywhere else, by a
   short fingerprint of each distinct one.  Suffixes whose first ``DEPTH`` words
   are unique cannot lie below a deep node and go no further.
2. The remaining suffixes are dealt out by prefix.  Prefixes have as many words as
   it takes for a group to fit in memory: groups are ranges between quantiles of
   the suffixes' first eight words, as many as the number of suffixes wants; where one
   prefix of eight words fills several of them, they part it by all ``DEPTH`` words.
3. Each group sorts its suffixes, takes the lengths of common prefixes of
   neighbours, and so has its subtree; for each deep node it finds the smallest
   doc_id below it, and tells each block which of its suffixes have a smaller one.
4. Each block removes the words covered by passages that a smaller doc_id has.

A suffix is told from another by one byte of hash for each of its words and 40
bits of hash of the whole passage.  Blocks send each distinct passage once, so a
passage that a third of all documents hold is one suffix a block.

Defined results: null has no words; documents shorter than ``DEPTH`` keep all;
equal doc_ids don't remove each other's words, and no doc_id counts as the greatest;
words are compared unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import compress as choose

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from rankweave.llm import kernels as K
from rankweave.llm.blocks import Blocks, answered, doc_ids, from_rows, runs, shard_of, to_rows
from rankweave.llm.storage import written

DEPTH = 13
#: Suffixes that one shard or one group of prefixes is meant to hold.
GROUP = 1_500_000
_SIGN = np.uint64(1 << 63)


class Passages:
    """The passages of one block: their words' symbols, fingerprints and documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, ids: np.ndarray) -> None:
        hashes, _, _, self.counts = K.words(data, offs, lower=False)
        self.symbols = (hashes >> np.uint64(40)).astype(np.uint8)
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        whole = K.rolling(hashes, DEPTH)
        n = np.maximum(self.counts - DEPTH + 1, 0)
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        self.at = at
        doc = (ids.astype(np.int64).view(np.uint64) ^ _SIGN)[np.repeat(np.arange(len(n)), n)]
        prints = whole[at]
        order = np.argsort(prints, kind="stable")
        sorted_prints = prints[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_prints[1:] != sorted_prints[:-1]
        first = np.flatnonzero(new)
        self.prints = sorted_prints[first]  # distinct, ascending
        self.which = np.empty(len(order), np.int64)  # of each passage, its distinct one
        self.which[order] = np.cumsum(new) - 1
        self.doc = doc
        docs = doc[order]
        self.least = np.minimum.reduceat(docs, first) if len(first) else docs
        self.most = np.maximum.reduceat(docs, first) if len(first) else docs
        self.sample = order[first]  # one passage of each distinct one

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First eight symbols, and the other five, of distinct passages as big-endian numbers."""
        at = self.at[self.sample[which]]
        head, tail = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(8):
            head = head << np.uint64(8) | self.symbols[at + k]
        for k in range(8, DEPTH):
            tail = tail << np.uint64(8) | self.symbols[at + k]
        return head, tail


def _describe(data: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch) -> tuple[bytes, list[int], int]:
    p = Passages(data, offs, doc_ids(rows.column(0)))
    head, _ = p.strings(np.arange(len(p.prints)))
    head.sort()
    step = max(1, len(head) // 64)
    return to_rows(rows), (head[step // 2 :: step] >> np.uint64(1)).astype(np.int64).tolist(), len(p.prints)


def _passages(row: dict) -> tuple[pa.RecordBatch, Passages, np.ndarray, np.ndarray]:
    rows = from_rows(row["body"])
    data, offs = K.text_column(rows.column(rows.num_columns - 1))
    return rows, Passages(data, offs, doc_ids(rows.column(0))), data, offs


def common_prefixes(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Symbols that each suffix of a sorted list shares with the one before it (0 for the first)."""
    out = np.zeros(len(head), np.int64)
    for k in range(8):
        out[1:] += (out[1:] == k) & ((head[1:] ^ head[:-1]) >> np.uint64(56 - 8 * k) == 0)
    for k in range(8, DEPTH):
        out[1:] += (out[1:] == k) & ((tail[1:] ^ tail[:-1]) >> np.uint64(8 * (DEPTH - 1 - k)) == 0)
    return out


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Where the leaves below each node of at least this depth begin: one run of
    neighbours that all share `depth` symbols is one node; a run of one is a leaf."""
    return np.flatnonzero(shared < depth)


def _subtree(blobs: list[bytes]) -> list[bytes]:
    """For each block, one bit for each suffix it sent: another block has a smaller doc_id."""
    parts = [K.unpack_all(b) for b in blobs]
    head = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    tail, prints, docs = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    docs = docs + np.repeat(np.concatenate([p[4] for p in parts]), [len(p[0]) for p in parts])
    order = np.lexsort((prints, tail, head))
    shared = common_prefixes(head[order], tail[order])
    told = prints[order]
    shared[1:][told[1:] != told[:-1]] = np.minimum(shared[1:][told[1:] != told[:-1]], DEPTH - 1)
    first = deep_nodes(shared, DEPTH)
    least = np.minimum.reduceat(docs[order], first)
    bits = np.empty(len(order), bool)
    bits[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < docs[order]
    ends = np.cumsum([len(p[0]) for p in parts])
    return [np.packbits(bits[end - len(p[0]) : end]).tobytes() for end, p in zip(ends, parts, strict=True)]


def group_of(head: np.ndarray, tail: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Group of each suffix between ascending edges; a first half that is several edges is
    parted among their groups by the other half."""
    low, high = np.searchsorted(edges, head, "left"), np.searchsorted(edges, head, "right")
    return low + (K.mix64(tail) % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64)


def stretches(removed: np.ndarray) -> tuple[int, int]:
    """How many stretches of removed words there are, and the length of the longest."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], removed.view(np.int8), [0]))))
    return len(edge) // 2, int((edge[1::2] - edge[::2]).max(initial=0))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, group: int = GROUP, block_bytes: int | None = None) -> DataFrame:
    """The columns in `keep` (doc_id first), n_words, n_removed, kept_sha256, and of the
    removed stretches (put together from overlapping passages) n_stretches and longest;
    with `with_text` also the kept words joined by one space, as ``text`` (null stays null).
    """
    given = docs.select(F.col("doc_id").cast("long"), *[c for c in keep if c != "doc_id"], F.col("text").alias("_text"))
    blocks = Blocks(given, _describe, block_bytes)
    n = blocks.size()
    shards = max(8, n // group)
    bits = min(64, max(1, n).bit_length() + 16)

    def prints(row: dict) -> Iterator[tuple[int, bytes]]:
        _, p, _, _ = _passages(row)
        for s, i, j in runs(shard_of(p.prints, shards)):
            yield s, K.pack(K.deltas(np.unique(p.prints[i:j] >> np.uint64(64 - bits))))

    def repeated(_: int, blobs: list[bytes]) -> list[bytes]:
        parts = [np.cumsum(K.unpack(b)[0], dtype=np.uint64) for b in blobs]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        return [np.packbits(np.isin(p, twice, assume_unique=True)).tobytes() for p in parts]

    elsewhere = answered(blocks.ask(prints), repeated, shards)
    elsewhere = written(elsewhere, "elsewhere")
    wanted = max(8, n // (2 * group))
    marks = blocks.table.select(F.explode("marks").alias("m"))
    edges = marks.select(F.percentile_approx("m", F.from_json(F.lit(json.dumps([k / wanted for k in range(1, wanted)])), "array<double>"), F.lit(min(2**31 - 1, 20 * wanted))).alias("q")).first().q or []
    edges = np.sort(np.array(edges, np.uint64) << np.uint64(1))

    def candidates(row: dict, p: Passages) -> np.ndarray:
        """Distinct passages that other blocks, or several documents of this one, have."""
        flag = p.least != p.most
        told = {a["shard"]: a["blob"] for a in row["answers0"] or []}
        for s, i, j in runs(shard_of(p.prints, shards)):
            short, back = np.unique(p.prints[i:j] >> np.uint64(64 - bits), return_inverse=True)
            flag[i:j] |= np.unpackbits(np.frombuffer(told[s], np.uint8), count=len(short)).astype(bool)[back]
        return np.flatnonzero(flag)

    def dealt(p: Passages, some: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Group of prefixes, and its suffixes in order."""
        head, tail = p.strings(some)
        g = group_of(head, tail, edges)
        order = np.lexsort((tail, head, g))
        for k, a, b in runs(g[order]):
            yield k, some[order[a:b]], head[order[a:b]], tail[order[a:b]]

    def suffixes(row: dict) -> Iterator[tuple[int, bytes]]:
        _, p, _, _ = _passages(row)
        for g, some, head, tail in dealt(p, candidates(row, p)):
            least = p.least[some]
            low = least.min()
            yield g, K.pack_all(K.deltas(head), tail, p.prints[some] & np.uint64(0xFFFFFFFFFF), least - low, np.array([low]))

    smaller = answered(blocks.ask(suffixes, elsewhere), lambda _, blobs: _subtree(blobs), len(edges) + 1)
    fields = [f for f in given.schema if f.name != "_text"]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_stretches", "longest")], *([T.StructField("text", T.StringType())] if with_text else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _kept({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})
                K.release()

    def _kept(row: dict) -> pa.RecordBatch:
        rows, p, data, offs = _passages(row)
        gone = np.zeros(len(p.prints), bool)
        told = {a["shard"]: a["blob"] for a in row["answers1"] or []}
        for g, some, _, _ in dealt(p, candidates(row, p)):
            gone[some] = np.unpackbits(np.frombuffer(told[g], np.uint8), count=len(some)).astype(bool)
        hit = gone[p.which] | (p.least[p.which] < p.doc)
        change = np.zeros(len(p.symbols) + 1, np.int32)
        np.add.at(change, p.at[hit], 1)
        np.add.at(change, p.at[hit] + DEPTH, -1)
        stays = np.cumsum(change[:-1]) == 0
        raw, ends = data.tobytes(), np.cumsum(p.counts)
        digests, texts, removed, parts = [], [], [], []
        for i, (end, n) in enumerate(zip(ends, p.counts, strict=True)):
            mask = stays[end - n : end]
            words = raw[offs[i] : offs[i + 1]].split()
            removed.append(int(n - mask.sum()))
            parts.append(stretches(~mask))
            kept = b" ".join(choose(words, mask.tolist()) if removed[-1] else words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        columns = [rows.column(k) for k in range(rows.num_columns - 1)] + [pa.array(p.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        columns += [pa.array([x[k] for x in parts], pa.int64()) for k in (0, 1)]
        if with_text:
            null = rows.column(rows.num_columns - 1).is_null().to_numpy(zero_copy_only=False)
            columns.append(pa.array(texts, pa.string(), mask=null))
        return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return blocks.with_answers(elsewhere, smaller).mapInArrow(finish, schema)
