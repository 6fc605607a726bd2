"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree a language: contexts of up to three bytes
with the counts of the byte that followed.  A byte's code length under a
language is that of PPM method C with frozen counts: in the longest context of
the tree, ``-log2(c / (n + d))`` if the byte was seen there (c of n, d distinct),
else the escape ``-log2(d / (n + d))`` plus the code length one order shorter,
down to one in 256.  A document goes to the language with the shortest code.

The counts come from a bounded sample of the labelled documents (``SAMPLE_ROWS``
and ``SAMPLE_BYTES``, shared out among the languages); every document is scored
over its whole text.  All code lengths of a four-byte string are resolved when
the model is frozen, so scoring is a table look-up for each byte.

Defined results: null text, or text without a letter: ``und`` with score 0.
Equal code lengths: the smaller language name.  No labelled row: ``und`` for all.
Every row is predicted by its own text, so repeated rows get equal predictions; a long
text is scored a piece at a time; an empty table gives an empty one, and columns other
than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rankweave.llm import kernels as K

#: Bounds of the sample that the trees are grown from: rows and bytes over all languages.
SAMPLE_ROWS, SAMPLE_BYTES = 40_000, 64 << 20

_LETTER = regex.compile(r"\p{L}").search


def byte_strings(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, it and the three before it as one uint32; zeros before a text's start."""
    n = len(data)
    key = data.astype(np.uint32)
    for back in (1, 2, 3):
        part = np.zeros(n, np.uint32)
        part[back:] = data[:-back] if n > back else 0
        for first in range(back):
            at = offs[:-1] + first
            part[at[at < offs[1:]]] = 0
        key |= part << np.uint32(8 * back)
    return key


def _costs(counts: np.ndarray, context: np.ndarray, shorter: np.ndarray, below) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PPM-C code lengths of (context, byte) pairs with these counts: each pair's own,
    and the contexts with the length of their escape."""
    names, where = np.unique(context, return_inverse=True)
    total = np.bincount(where, counts)
    seen = np.bincount(where, counts > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = -np.log2(counts / (total + seen)[where])
        escape = np.where(total > 0, -np.log2(seen / (total + seen)), 0.0)
    return np.where(counts > 0, own, escape[where] + below(shorter)), names, escape


class _Slots:
    """Open-addressing table from uint32 keys to their positions."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.value = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.value[slot[todo]] < 0
            _, first = np.unique(np.where(free, slot[todo], -1 - np.arange(len(todo))), return_index=True)
            put = np.zeros(len(todo), bool)
            put[first] = True
            put &= free
            self.keys[slot[todo[put]]], self.value[slot[todo[put]]] = keys[todo[put]], todo[put]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            out[wrong] = self.value[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


@dataclass
class Model:
    """Frozen trees of all languages, resolved to code lengths in bits."""

    langs: list[str]
    slots: _Slots  # of the four-byte strings that any language has
    cost4: np.ndarray  # languages x four-byte strings
    keys3: np.ndarray  # sorted three-byte strings that any language has
    cost3: np.ndarray
    escape3: np.ndarray  # languages x three-byte strings, as contexts
    cost2: np.ndarray  # languages x 65536
    escape2: np.ndarray

    @staticmethod
    def freeze(langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """tables: for each language the four-byte strings and how often each occurred."""
        keys4 = np.unique(np.concatenate([k for k, _ in tables])) if tables else np.zeros(0, np.uint32)
        keys3 = np.unique(np.concatenate([keys4 & 0xFFFFFF, keys4 >> 8, np.zeros(1, np.uint32)]))
        cost4, cost3, escape3, cost2, escape2 = [], [], [], [], []
        for keys, n in tables:
            n = n.astype(np.float64)
            c1 = np.bincount(keys & 0xFF, n, 256)
            first, _, _ = _costs(c1, np.zeros(256, np.int64), np.arange(256), lambda s: np.full(len(s), 8.0))
            c2 = np.bincount(keys & 0xFFFF, n, 1 << 16)
            pairs = np.arange(1 << 16)
            k2, names, esc = _costs(c2, pairs >> 8, pairs & 0xFF, lambda s, first=first: first[s])
            e1 = np.zeros(256)
            e1[names] = esc
            cost2.append(k2)
            u3, w3 = np.unique(keys & 0xFFFFFF, return_inverse=True)
            c3 = np.zeros(len(keys3))
            c3[np.searchsorted(keys3, u3)] = np.bincount(w3, n)
            k3, names, esc = _costs(c3, keys3 >> 8, keys3 & 0xFFFF, lambda s, k2=k2: k2[s])
            e2 = np.zeros(1 << 16)
            e2[names] = esc
            escape2.append(e2)
            cost3.append(k3)
            c4 = np.zeros(len(keys4))
            c4[np.searchsorted(keys4, keys)] = n
            k4, names, esc = _costs(c4, keys4 >> 8, keys4 & 0xFFFFFF, lambda s, k3=k3: k3[np.searchsorted(keys3, s)])
            e3 = np.zeros(len(keys3))
            e3[np.searchsorted(keys3, names)] = esc
            escape3.append(e3)
            cost4.append(k4)
        f = lambda x: np.array(x, np.float32)
        return Model(langs, _Slots(keys4), f(cost4), keys3, f(cost3), f(escape3), f(cost2), f(escape2))

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text under each language: languages x texts."""
        out = np.zeros((len(self.langs), len(offs) - 1))
        full = np.flatnonzero(np.diff(offs) > 0)
        if not len(full) or not self.langs:
            return out
        for a in range(0, len(full), 1 << 14):
            rows = full[a : a + (1 << 14)]
            self._bits(data[offs[rows[0]] : offs[rows[-1] + 1]], np.append(offs[rows], offs[rows[-1] + 1]) - offs[rows[0]], out, rows)
        return out

    def _bits(self, data: np.ndarray, offs: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        at = 0
        while at < len(data):  # pieces of CHUNK bytes, three bytes of context carried along
            to = min(len(data), at + K.CHUNK)
            lead = min(3, at)
            inner = offs[(offs > at - lead) & (offs < to)]
            bounds = np.concatenate(([at - lead], inner, [to])) - (at - lead)
            key = byte_strings(data[at - lead : to], bounds)[lead:]
            first = int(np.searchsorted(offs, at, "right")) - 1
            starts = np.concatenate(([0], offs[(offs > at) & (offs < to)] - at))
            docs = rows[first : first + len(starts)]
            found = self.slots.find(key)
            miss = np.flatnonzero(found < 0)
            found[miss] = 0
            rest = self._missing(key[miss]) if len(miss) else None
            for k in range(len(self.langs)):
                cost = self.cost4[k][found] if self.cost4.shape[1] else np.zeros(len(key), np.float32)
                if rest is not None:
                    cost[miss] = rest[k]
                out[k, docs] += np.add.reduceat(cost, starts, dtype=np.float64)
            at = to

    def _missing(self, key: np.ndarray) -> np.ndarray:
        """Code lengths of four-byte strings that no language has."""
        last = max(len(self.keys3) - 1, 0)

        def at3(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i = np.minimum(np.searchsorted(self.keys3, k), last)
            return i, self.keys3[i] == k

        ctx, has_ctx = at3(key >> np.uint32(8))
        tri, has_tri = at3(key & np.uint32(0xFFFFFF))
        pair, before = key & np.uint32(0xFFFF), (key >> np.uint32(8)) & np.uint32(0xFFFF)
        shorter = np.where(has_tri, self.cost3[:, tri], self.escape2[:, before] + self.cost2[:, pair])
        return np.where(has_ctx, self.escape3[:, ctx], 0) + shorter


def held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Grow the trees from a bounded sample of the rows of `docs` with text and lang.

    The bound is on what is expected of each language.  Besides, the labelled document
    of least hash that has text is always taken, so no language is left out; with
    documents beyond a language's share, the sample exceeds `size` by one of each.
    """
    drawn = (F.xxhash64(F.col("doc_id"), F.lit("langid")) / F.lit(2.0**64)) + 0.5
    mark = F.struct(drawn.alias("drawn"), F.xxhash64("text").alias("of_text"))
    known = docs.select("doc_id", "lang", "text").filter("text is not null and lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"), F.min(F.when(F.octet_length("text") > 0, mark)).alias("least")).collect()
    sizes = sorted(sizes, key=lambda r: r.lang)
    if not sizes:
        return Model.freeze([], [])
    share = {r.lang: min(1.0, rows / len(sizes) / r.n, size / len(sizes) / max(r.b, 1)) for r in sizes}
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    first = {r.lang: r.least.of_text for r in sizes if r.least is not None}
    at = {r.lang: r.least.drawn for r in sizes if r.least is not None}
    taken = drawn <= limit[F.col("lang")]
    if first:
        least_at, least_of = (F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) for given in (at, first))
        taken |= F.coalesce((drawn == least_at[F.col("lang")]) & (F.xxhash64("text") == least_of[F.col("lang")]), F.lit(False))
    sample = known.filter(taken).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            data, offs = K.text_column(batch.column(1))
            lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, b in K.slices(data, offs):
                part, cut = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                key = byte_strings(part, cut) | (np.repeat(lang[a:b], np.diff(cut)) << np.uint64(32))
                keys, n = np.unique(key, return_counts=True)
                names = codes.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    counted = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted["lang"].to_pylist(), dtype=object)
    keys, n = counted["key"].to_numpy().astype(np.uint32), counted["n"].to_numpy()
    order = np.argsort(keys)
    names, keys, n = names[order], keys[order], n[order]
    langs = [r.lang for r in sizes if (names == r.lang).any()]
    return Model.freeze(langs, [(keys[names == x], n[names == x]) for x in langs])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(2)
            data, offs = K.text_column(column)
            bits = model.bits(data, offs)
            best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            if model.langs:
                best = bits.argmin(0)
                score = 1 / np.exp2(np.minimum(bits.min(0) - bits, 0)).sum(0)
            said, sure = [], []
            for i, value in enumerate(column):
                lettered = bool(model.langs) and value.is_valid and _LETTER(value.as_py()) is not None
                said.append(model.langs[best[i]] if lettered else "und")
                sure.append(float(score[i]) if lettered else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    given = held_out(docs).select(F.col("doc_id").cast("long"), "held_out", "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, and predict every row."""
    return predict(docs, fit(held_out(docs).filter(~F.col("held_out"))))
