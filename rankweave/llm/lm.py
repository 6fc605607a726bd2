"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is an interpolated trigram over all training documents, with nothing
pruned.  Tokens are lower-cased words and one end for each document.

1. Blocks of documents ask for the counts of their distinct words.  A shard of
   the vocabulary adds up the training counts and numbers its words, frequent
   ones first, so their numbers are small.
2. Blocks ask for the counts of their distinct pairs of neighbours (a, b), from
   shards that hold all of a root a, or a part of a frequent one's pairs.  From
   the exact counts a block has each bigram's smoothed probability, and how often
   each pair is met as a context.
3. Blocks ask for their distinct trigrams (t, u, w), with their training counts,
   the pair's probability and the context's count.  Shards hold roots u, or parts
   of frequent ones by t and w.  A shard adds the counts up, builds the trie of its
   trigrams, writes it to a file that it maps into memory, and answers each with
   its quantised probability.
4. Blocks add up what their tokens cost.

What a count or a probability is does not depend on how roots are dealt out, so
scores are the same for every size of shard.  A word, pair or trigram that is
everywhere is one question a block.  Every table, question and answer grows with
the corpus; no task holds more than a shard or a block, and nothing is gathered
on the driver but a few sums.

A trie's file is the task's own: it is made in the task's temporary folder, mapped,
unlinked at once and gone with the trie; nothing else reads it.

Defined results: null and empty texts are one end token; without training
tokens every token has probability 1 and scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankweave.llm import kernels as K
from rankweave.llm.blocks import NO_ID, Blocks, answered, doc_ids, runs, shard_of
from rankweave.llm.elias_fano import Trie, quantise, restore
from rankweave.llm.storage import written

#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: Tokens for each shard of words, of pairs and of trigrams; occurrences of a part of a root.
WORD_SHARD, PAIR_SHARD, TRIGRAM_SHARD, PART = 4_000_000, 1_200_000, 700_000, 200_000
#: Weights of the shorter contexts: of unigrams in bigrams, of bigrams in trigrams.
KAPPA = (1000.0, 6.0)

_END = K.mix64(np.array([0x454E44], np.uint64))[0]
_UNKNOWN = np.uint64((1 << 52) - 1)  # number of words that no training document has
_START = np.uint64((1 << 52) - 2)


def _describe(data: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch) -> tuple[bytes, list[int], int]:
    """Tokens of a block as places in its sorted list of distinct word hashes."""
    hashes, _, _, counts = K.words(data, offs, lower=True)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.full(len(hashes) + len(counts), _END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = hashes
    names, place = np.unique(tokens, return_inverse=True)
    train = np.asarray(rows.column(1).to_numpy(zero_copy_only=False), bool)
    body = K.pack_all(K.deltas(names), place, counts + 1, doc_ids(rows.column(0)).astype(np.int64).view(np.uint64), train)
    return body, [int((counts + 1)[train].sum()), int(train.sum())], len(tokens)


class _Tokens:
    def __init__(self, body: bytes) -> None:
        names, place, self.counts, ids, train = K.unpack_all(body)
        self.names = np.cumsum(names, dtype=np.uint64)
        self.place, self.counts = place.astype(np.int64), self.counts.astype(np.int64)
        self.doc_ids, self.train = ids.view(np.int64), train.astype(bool)
        self.ends = np.cumsum(self.counts)
        self.in_train = np.repeat(self.train, self.counts)


def _word_answers(shard: int, blobs: list[bytes], shards: int) -> list[bytes]:
    parts = [K.unpack_all(b) for b in blobs]
    names = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    every, where = np.unique(np.concatenate(names), return_inverse=True)
    count = np.bincount(where, np.concatenate([p[1] for p in parts]).astype(np.float64), len(every)).astype(np.uint64)
    serial = np.empty(len(every), np.uint64)
    serial[np.argsort(~count, kind="stable")] = np.arange(len(every), dtype=np.uint64)
    number = serial * np.uint64(shards) + np.uint64(shard)
    number[count == 0] = _UNKNOWN
    known = np.array([(count > 0).sum()], np.uint64)
    ends = np.cumsum([len(n) for n in names])
    out = []
    for end, n in zip(ends, names, strict=True):
        w = where[end - len(n) : end]
        out.append(K.pack_all(count[w], number[w], known))
    return out


class _Grams:
    """Distinct pairs and trigrams of a block in order, and which each token asks for.

    Words go by the place of their number among the block's; unknown words are one.
    """

    def __init__(self, tokens: _Tokens, count: np.ndarray, number: np.ndarray, starts: int, shards: tuple[int, int], part: int = PART) -> None:
        self.values, rank = np.unique(np.concatenate((number, [_START])), return_inverse=True)
        self.count = np.zeros(len(self.values), np.uint64)
        self.count[rank] = np.concatenate((count, [np.uint64(starts)]))
        w = rank[tokens.place]
        first = tokens.ends - tokens.counts
        before = np.empty(len(w), np.int64)
        before[1:] = w[:-1]
        before[first] = rank[-1]
        self.pairs, of = np.unique(before.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64), return_inverse=True)
        self.a, self.b = (self.pairs >> np.uint64(32)).astype(np.int64), (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.pair_seen = np.bincount(of, tokens.in_train, len(self.pairs)).astype(np.uint64)
        # a root's parts are told apart by what else the question holds
        self.parts = np.maximum((self.count + np.uint64(part - 1)) // np.uint64(part), 1)
        self.spread = K.mix64(self.values + np.uint64(0x5BD1E995))
        known = self.values[self.a] != _UNKNOWN
        self.pair_order, self.pair_runs = self._dealt(self.a[known], self.spread[self.b[known]], shards[0])
        self.pair_order = np.flatnonzero(known)[self.pair_order]
        asks = known[of]
        asks[first] = False
        self._trigram_input = tokens, of, w, np.flatnonzero(asks), shards[1]

    def with_trigrams(self) -> _Grams:
        tokens, of, w, self.asks, shards = self._trigram_input
        turned = np.argsort(self.b << 32 | self.a)
        place = np.empty(len(turned), np.uint64)
        place[turned] = np.arange(len(turned), dtype=np.uint64)
        key = place[of[self.asks - 1]] << np.uint64(32) | w[self.asks].astype(np.uint64)
        every, self.which = np.unique(key, return_inverse=True)  # in order of u, t, w
        self.context = turned[(every >> np.uint64(32)).astype(np.int64)]
        self.pair = np.empty(len(every), np.int64)
        self.pair[self.which] = of[self.asks]
        self.seen = np.bincount(self.which, tokens.in_train[self.asks], len(every)).astype(np.uint64)
        u, t = self.a[self.pair], self.a[self.context]
        rest = K.mix64(self.spread[t] + self.spread[self.b[self.pair]] * np.uint64(3))
        self.order, self.runs = self._dealt(u, rest, shards)
        return self

    def _dealt(self, root: np.ndarray, rest: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of questions by shard, and which of them each shard gets."""
        home = K.mix64(self.values[root] * np.uint64(0x9E3779B97F4A7C15) + rest % self.parts[root])
        shard = shard_of(home, shards)
        order = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
        return order, runs(shard[order])

    def ask_pairs(self) -> Iterator[tuple[int, bytes]]:
        for s, i, j in self.pair_runs:
            k = self.pair_order[i:j]
            yield s, K.pack_all(K.deltas(self.values[self.a[k]]), self.values[self.b[k]], self.pair_seen[k])

    def ask_trigrams(self, told: dict[int, bytes], unigram_total: float) -> Iterator[tuple[int, bytes]]:
        """With the answers about pairs."""
        n = np.zeros(len(self.pairs))
        for s, i, j in self.pair_runs:
            n[self.pair_order[i:j]] = K.unpack(told[s])[0]
        count = self.count.astype(np.float64)
        unigram = (count + 1) / unigram_total
        p2 = (n + KAPPA[0] * unigram[self.b]) / (count[self.a] + KAPPA[0])
        code = quantise(np.log10(p2)).astype(np.uint64) << np.uint64(1) | (n > 0).astype(np.uint64)
        for s, i, j in self.runs:
            k = self.order[i:j]
            pair, context = self.pair[k], self.context[k]
            root, before = self.values[self.a[pair]], self.values[self.a[context]]
            step = before.copy()  # ascends within a root
            step[1:] -= np.where(root[1:] == root[:-1], before[:-1], np.uint64(0))
            yield s, K.pack_all(K.deltas(root), step, self.values[self.b[pair]], self.seen[k], code[pair], n[context].astype(np.uint64))


def _distinct(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _pair_answers(blobs: list[bytes]) -> list[bytes]:
    parts = [K.unpack_all(b) for b in blobs]
    a = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    b, seen = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    order = np.lexsort((b, a))
    group = np.cumsum(_distinct([a[order], b[order]])) - 1
    total = np.bincount(group, seen[order])
    answer = np.empty(len(order), np.uint64)
    answer[order] = total[group]
    ends = np.cumsum([len(p[0]) for p in parts])
    return [K.pack(answer[end - len(p[0]) : end]) for end, p in zip(ends, parts, strict=True)]


def _trie_answers(blobs: list[bytes]) -> list[bytes]:
    parts = [K.unpack_all(b) for b in blobs]
    sizes = [len(p[0]) for p in parts]
    root = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    step, word, seen, code, ctx_n = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    first = _distinct([root])
    first[np.cumsum([0, *sizes[:-1]])] = True
    first = np.flatnonzero(first)
    context = np.cumsum(step, dtype=np.uint64)
    context -= np.repeat(context[first] - step[first], np.diff(np.append(first, len(root))))
    del parts
    roots, r = np.unique(root, return_inverse=True)
    words, both = np.unique(np.concatenate((context, word)), return_inverse=True)
    t, w = both[: len(root)], both[len(root) :]
    v = len(words)
    ctx_key = r * v + t
    if len(roots) * v * v < 1 << 62:  # one key; what the blocks sent is in its order already
        order = np.argsort(ctx_key * v + w, kind="stable")
    else:
        order = np.lexsort((w, ctx_key))
    new = _distinct([ctx_key[order], w[order]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    n = np.bincount(which, seen)
    ctx_key, w, r, code, ctx_n = ctx_key[one], w[one], r[one], code[one], ctx_n[one].astype(np.float64)
    # distinct pairs (u, w) and contexts (u, t) of these trigrams
    pairs, pair_at, pair_of = np.unique(r * v + w, return_index=True, return_inverse=True)
    fresh = _distinct([ctx_key])
    contexts, ctx_of, ctx_at = ctx_key[fresh], np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    p2 = restore(code[pair_at] >> np.uint64(1))
    back = np.log10(KAPPA[1] / (ctx_n[ctx_at] + KAPPA[1]))
    met_pair, met_ctx = (code[pair_at] & np.uint64(1)) == 1, ctx_n[ctx_at] > 0
    in_trie = np.flatnonzero(n > 0)
    p3 = np.log10((n[in_trie] + KAPPA[1] * 10.0 ** p2[pair_of[in_trie]]) / (ctx_n[in_trie] + KAPPA[1]))
    pair_place, ctx_place = np.cumsum(met_pair) - 1, np.cumsum(met_ctx) - 1
    trie = Trie.build(
        len(roots), v, pairs[met_pair], p2[met_pair], contexts[met_ctx], back[met_ctx], ctx_place[ctx_of[in_trie]], pair_place[pair_of[in_trie]], p3
    ).mapped()
    place, shorter = trie.pairs(r[pair_at], w[pair_at], p2)
    at, weight = trie.contexts(r[ctx_at], contexts % v)
    cost = trie.trigrams(at[ctx_of], place[pair_of], weight[ctx_of], shorter[pair_of])
    answer = np.rint(cost * -2048).astype(np.uint64)[which]
    ends = np.cumsum(sizes)
    return [K.pack(answer[end - size : end]) for end, size in zip(ends, sizes, strict=True)]


def score(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 7 = 2", block_bytes: int = BLOCK_BYTES, shards: tuple[int, int, int] = (WORD_SHARD, PAIR_SHARD, TRIGRAM_SHARD), part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    document, under the model of those for which `held_out` is not true.

    `shards`: tokens of the corpus for each shard of words, pairs and trigrams; `part`:
    occurrences of a root in each of its parts.  Neither changes a score.
    """
    given = docs.select(F.col("doc_id").cast("long"), (~F.coalesce(F.expr(held_out), F.lit(False))).alias("train"), "text")
    blocks = Blocks(given, _describe, block_bytes)
    sums = blocks.table.agg(F.sum("size").alias("n"), *[F.sum(F.element_at("marks", k)).alias(c) for k, c in ((1, "train"), (2, "starts"))]).first()
    n, total, starts = sums.n or 0, sums.train or 0, sums.starts or 0
    word_shards, pair_shards, trie_shards = (max(8, n // size) for size in shards)

    def ask_words(row: dict) -> Iterator[tuple[int, bytes]]:
        tokens = _Tokens(row["body"])
        seen = np.bincount(tokens.place, tokens.in_train, len(tokens.names)).astype(np.uint64)
        for s, i, j in runs(shard_of(tokens.names, word_shards)):
            yield s, K.pack_all(K.deltas(tokens.names[i:j]), seen[i:j])

    words = answered(blocks.ask(ask_words), lambda s, blobs: _word_answers(s, blobs, word_shards), word_shards)
    words = written(words, "words")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [int(K.unpack_all(b)[2][0]) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.int64())], ["shard", "known"])

    one = words.groupBy("shard").agg(F.min_by("blob", "block").alias("blob"))
    distinct = one.mapInArrow(vocabulary, "shard long, known long").agg(F.sum("known")).first()[0] or 0
    unigram_total = float(total + distinct + 1)

    def grams(row: dict) -> tuple[_Tokens, np.ndarray, _Grams]:
        tokens = _Tokens(row["body"])
        told = sorted((a["shard"], a["blob"]) for a in row["answers0"] or [])
        parts = [K.unpack_all(b) for _, b in told]
        count, number = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return tokens, count, _Grams(tokens, count, number, starts, (pair_shards, trie_shards), part)

    def ask_pairs(row: dict) -> Iterator[tuple[int, bytes]]:
        return grams(row)[2].ask_pairs()

    def ask_trigrams(row: dict) -> Iterator[tuple[int, bytes]]:
        return grams(row)[2].with_trigrams().ask_trigrams({a["shard"]: a["blob"] for a in row["answers1"] or []}, unigram_total)

    pairs = answered(blocks.ask(ask_pairs, words), lambda _, blobs: _pair_answers(blobs), pair_shards)
    costs = answered(blocks.ask(ask_trigrams, words, pairs), lambda _, blobs: _trie_answers(blobs), trie_shards)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _scored({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})
                K.release()

    def _scored(row: dict) -> pa.RecordBatch:
        tokens, count, g = grams(row)
        g.with_trigrams()
        base = np.log10((count.astype(np.float64) + 1) / unigram_total)[tokens.place]
        known = (count > 0)[tokens.place]
        answer, told = np.zeros(len(g.order)), {a["shard"]: a["blob"] for a in row["answers1"] or []}
        for s, i, j in g.runs:
            answer[g.order[i:j]] = restore(K.unpack(told[s])[0])
        cost = base.copy()
        cost[g.asks] = answer[g.which]
        first = tokens.ends - tokens.counts
        add = lambda x: np.add.reduceat(x, first)
        m = len(first)
        columns = [
            pa.array(tokens.doc_ids, mask=tokens.doc_ids == NO_ID), pa.array(~tokens.train), pa.array(tokens.counts), pa.array(add(known.astype(np.int64))),
            pa.array(np.full(m, total, np.int64)), pa.array(add(base)), pa.array(add(cost)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.with_answers(words, costs).mapInArrow(finish, schema)
