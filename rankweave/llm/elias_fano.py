"""Elias-Fano sequences over numpy arrays, and n-gram tries made of them.

A sequence keeps n non-decreasing integers below u in n * (2 + log2(u / n)) bits:
the lower bits of each packed side by side, the upper ones in unary, bucket by
bucket.  ``find`` looks up many values at once: the bucket from the unary part,
then a binary search over the bucket's lower bits.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """n, width (lower bits of each), low (packed words), high (unary bytes)."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.low, self.high = n, width, low, high
        self._mask = np.uint64((1 << width) - 1)
        self._zeros: np.ndarray | None = None
        self._ones: np.ndarray | None = None

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            bits = np.arange(n, dtype=np.uint64) * np.uint64(width)
            part, word, off = v & np.uint64((1 << width) - 1), (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
            np.add.at(low, word, part << off)
            over = np.flatnonzero(off + np.uint64(width) > 64)
            np.add.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        top = (v >> np.uint64(width)).astype(np.int64)
        unary = np.zeros(n + (int(top[-1]) if n else 0) + 1, bool)
        unary[top + np.arange(n)] = True
        return EliasFano(n, width, low, np.packbits(unary))

    def _lower(self, i: np.ndarray) -> np.ndarray:
        bits = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
        first = self.low[word] >> off
        rest = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (first | rest) & self._mask

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: the first index whose value is at least x, and whether it equals x."""
        if self._zeros is None:  # where each bucket ends
            self._zeros = np.flatnonzero(np.unpackbits(self.high) == 0)
        zeros = self._zeros
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        last = len(zeros) - 1
        bucket = x >> np.uint64(self.width)
        beyond = bucket > np.uint64(last)
        bucket = np.minimum(bucket, np.uint64(last)).astype(np.int64)
        end = np.minimum(zeros[bucket] - bucket, self.n)
        start = np.where(bucket > 0, zeros[np.maximum(bucket - 1, 0)] - np.maximum(bucket - 1, 0), 0)
        start = np.minimum(start, self.n)
        want, stop = x & self._mask, end
        lo, hi = start, end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lower(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        inside = lo < stop
        found = np.zeros(len(x), bool)
        k = np.flatnonzero(inside & ~beyond)
        found[k] = self._lower(lo[k]) == want[k]
        lo[beyond] = self.n
        return lo, found

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` or ``find``, by whether the values ascend."""
        return self.merge(x) if (x[1:] >= x[:-1]).all() else self.find(x)

    def merge(self, x: np.ndarray, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """What ``find`` gives, for many ascending values: the sequence is decoded once, a
        chunk at a time, beside them."""
        index, found = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        done = 0
        for first in range(0, self.n, chunk):
            values = self.at(np.arange(first, min(self.n, first + chunk)))
            to = int(np.searchsorted(x, values[-1], "right"))
            k = np.searchsorted(values, x[done:to])
            index[done:to], found[done:to] = first + k, values[k] == x[done:to]
            done = to
        return index, found

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        if self._ones is None:
            self._ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        return ((self._ones[i] - i).astype(np.uint64) << np.uint64(self.width)) | self._lower(i)


def quantise(log10: np.ndarray) -> np.ndarray:
    """Probabilities as steps of 1/2048 of a decade; those below 10**-31 do not fit."""
    steps = np.rint(-log10 * 2048)
    if len(steps) and steps.max() > 65535:
        raise OverflowError("a probability below 10**-31")
    return steps.astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -2048


class Trie:
    """Trigrams (t, r, w) below roots r, in levels of Elias-Fano sequences.

    * ``successors``: the words w after each root, with the smoothed bigram
      probability, and monotone pointers to each root's first;
    * ``contexts``: the words t before each root, with the weight of backing off;
    * ``trigrams``: below each context, the words that follow it - not as word
      numbers but as positions among the root's successors, which a word after
      (t, r) always is one of.  The relative numbers are small, so this largest
      level takes few bits.

    Roots and words are numbers below ``roots`` and ``words``.
    """

    LEVELS = ("successors", "pointers", "contexts", "trigrams")

    def __init__(self, roots: int, words: int, longest: int, levels: dict[str, EliasFano], codes: dict[str, np.ndarray]) -> None:
        self.roots, self.words, self.longest, self.levels, self.codes = roots, words, longest, levels, codes

    @staticmethod
    def build(roots: int, words: int, pairs: np.ndarray, p2: np.ndarray, contexts: np.ndarray, back3: np.ndarray, ctx_of: np.ndarray, pair_of: np.ndarray, p3: np.ndarray) -> Trie:
        """From the distinct pairs (root * words + word) and contexts (root * words + context),
        both ascending, and for each trigram, in order of context and word, the places of its
        context and its pair among them; log10 probabilities of pairs and trigrams, and of
        backing off from each context."""
        pair_root = pairs.astype(np.int64) // max(words, 1)
        first = np.searchsorted(pair_root, np.arange(roots + 1))
        longest = int(np.diff(first).max(initial=0)) + 1
        relative = pair_of - first[pair_root[pair_of]] if len(pair_of) else pair_of
        levels = {
            "successors": EliasFano.build(pairs, roots * words + 1),
            "pointers": EliasFano.build(first, len(pairs) + 1),
            "contexts": EliasFano.build(contexts, roots * words + 1),
            "trigrams": EliasFano.build(ctx_of * longest + relative, len(contexts) * longest + 1),
        }
        return Trie(roots, words, longest, levels, {"p2": quantise(p2), "back3": quantise(back3), "p3": quantise(p3)})

    def pairs(self, root: np.ndarray, word: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among its root's successors (-1: none), and log10 of the bigram
        probability; `unseen` holds that of words that never follow the root."""
        key = root.astype(np.uint64) * np.uint64(self.words) + word.astype(np.uint64)
        at, has = self.levels["successors"].look(key)
        out, place = unseen.copy(), np.full(len(key), -1, np.int64)
        k = np.flatnonzero(has)
        out[k] = restore(self.codes["p2"][at[k]])
        place[k] = at[k] - self.levels["pointers"].at(root[k].astype(np.int64)).astype(np.int64)
        return place, out

    def contexts(self, root: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each context (-1: none), and log10 of the weight of backing off from it."""
        key = root.astype(np.uint64) * np.uint64(self.words) + context.astype(np.uint64)
        at, met = self.levels["contexts"].look(key)
        k = np.flatnonzero(met)
        out = np.zeros(len(key))
        out[k] = restore(self.codes["back3"][at[k]])
        return np.where(met, at, -1), out

    def trigrams(self, context: np.ndarray, place: np.ndarray, back: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """log10 probability of the word at a place among its root's successors after a context."""
        out = back + shorter
        k = np.flatnonzero((context >= 0) & (place >= 0))
        at, seen = self.levels["trigrams"].look(context[k].astype(np.uint64) * np.uint64(self.longest) + place[k].astype(np.uint64))
        out[k[seen]] = restore(self.codes["p3"][at[seen]])
        return out

    def save(self, file) -> None:
        """All levels in one file: a line of JSON, then the arrays, aligned to 8 bytes."""
        arrays, head = [], {"roots": self.roots, "words": self.words, "longest": self.longest, "levels": {}, "arrays": []}
        for name, e in self.levels.items():
            head["levels"][name] = [e.n, e.width]
            arrays += [(f"{name}.low", e.low), (f"{name}.high", e.high)]
        arrays += list(self.codes.items())
        at = 0
        for name, a in arrays:
            head["arrays"].append([name, a.dtype.str, len(a), at])
            at += -(-a.nbytes // 8) * 8
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 8) + b"\n"
        file.write(line)
        for _, a in arrays:
            file.write(a.tobytes())
            file.write(bytes(-a.nbytes % 8))
        file.flush()

    @staticmethod
    def open(file) -> Trie:
        """Levels as views of the memory-mapped file."""
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        start = held.find(b"\n") + 1
        head = json.loads(held[:start])
        arrays = {name: np.frombuffer(held, kind, n, start + at) for name, kind, n, at in head["arrays"]}
        levels = {name: EliasFano(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"]) for name, (n, width) in head["levels"].items()}
        return Trie(head["roots"], head["words"], head["longest"], levels, {k: v for k, v in arrays.items() if "." not in k})

    def mapped(self) -> Trie:
        """This trie through a file of the task's own, which goes when the trie does."""
        fd, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(fd, "w+b") as f:
                self.save(f)
                return Trie.open(f)
        finally:
            os.unlink(path)
