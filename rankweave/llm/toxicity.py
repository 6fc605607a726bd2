"""Toxicity by classifier chains over hashed word features.

The chain predicts one category after the other with logistic regressions.  A
later model gets, besides the words, the probabilities of the earlier
categories as log-odds; what it is trained with are out-of-fold probabilities,
each from a model that never saw that row.

A text's features are the presence of its words (lower-case runs of letters and
digits) and of their prefixes of four, five and six bytes.  For each category
and each training fold, features are chosen by their likelihood ratio against
the category; the models are fitted on about ``SAMPLE_ROWS`` labelled rows of about
``SAMPLE_BYTES`` of text at most, drawn by a hash of their ids.  Every document is
scored over its whole text.

Defined results: null and empty texts have no features and get the chain's
intercepts; without two classes in a category its probability is the mean label
(0 without labels); rows with a null label do not train that category.  Every row is
scored by its own text, so repeated rows and rows of one doc_id get what their texts
get; of the texts of a labelled doc_id the one of least hash trains.  An empty table
gives an empty one; columns other than text and those kept are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankweave.llm import kernels as K
from rankweave.llm.blocks import cut
from rankweave.llm.storage import written

#: Bounds of the labelled sample the chain is fitted on; features kept for a category.
SAMPLE_ROWS, SAMPLE_BYTES, CHOSEN = 20_000, 256 << 20, 1024
FOLDS = 5
PREFIXES = (4, 5, 6)
#: Rows with the category that must have a feature for it to be chosen.
SUPPORT = 3
SHARDS = 16

_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SALT = [np.uint64(x) for x in (0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]


def features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once; with `wanted` (sorted) only those features, as
    their positions in it."""
    rows, hashes, at = [], [], 0
    marks = None
    if wanted is not None:
        marks = np.zeros(1 << 20, bool)
        marks[wanted & np.uint64(0xFFFFF)] = True
    n = len(offs) - 1
    for a, b in K._pieces(data, offs):
        first, last = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b, "left")
        cuts = np.clip(offs[first : last + 1] - a, 0, b - a)
        s, e = K.word_bounds(data[a:b], cuts, _APART)
        if not len(s):
            continue
        row = np.repeat(np.arange(first, last), np.diff(np.searchsorted(s, cuts, "left")))
        parts = [(s, e), *((s, np.minimum(e, s + k)) for k in PREFIXES)]
        for k, h in enumerate(K.hash_ranges(data[a:b], True, parts)):
            h = h ^ _SALT[k]
            if wanted is None:
                long = slice(None) if not k else e - s > PREFIXES[k - 1]
                rows.append(row[long])
                hashes.append(h[long])
                continue
            near = np.flatnonzero(marks[h & np.uint64(0xFFFFF)] & (True if not k else e - s > PREFIXES[k - 1]))
            where = np.minimum(np.searchsorted(wanted, h[near]), max(len(wanted) - 1, 0))
            hit = wanted[where] == h[near] if len(wanted) else np.zeros(len(near), bool)
            rows.append(row[near][hit])
            hashes.append(where[hit].astype(np.uint64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[once], value[once]


@dataclass
class Linear:
    """Logistic regression: intercept, one weight a feature, one an earlier category."""

    bias: float
    weight: np.ndarray
    chained: np.ndarray

    def probability(self, row: np.ndarray, feature: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weight[feature], n) + before @ self.chained
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(row: np.ndarray, feature: np.ndarray, allowed: np.ndarray, before: np.ndarray, label: np.ndarray, ridge: float = 0.3, rounds: int = 250) -> Linear:
    """Accelerated gradient descent, step by step scaled by each feature's frequency."""
    n, width = len(label), len(allowed)
    keep = allowed[feature]
    row, feature = row[keep], feature[keep]
    mean = float(label.mean()) if n else 0.0
    if n == 0 or mean in (0.0, 1.0):
        return Linear(float(_logit(np.array([mean]))[0]), np.zeros(width), np.zeros(before.shape[1]))
    size = np.bincount(row, minlength=n) + 1 + before.shape[1]
    scale_w = np.bincount(feature, size[row] * 0.25, width) + ridge
    scale_c = (np.abs(before) * np.abs(before).max(1, initial=1)[:, None] * size[:, None]).sum(0) * 0.25 + ridge
    scale_b = 0.25 * size.sum()
    bias, w, c = float(_logit(np.array([mean]))[0]), np.zeros(width), np.zeros(before.shape[1])
    pb, pw, pc = bias, w, c
    for k in range(rounds):
        m = k / (k + 3)
        vb, vw, vc = bias + m * (bias - pb), w + m * (w - pw), c + m * (c - pc)
        z = vb + np.bincount(row, vw[feature], n) + before @ vc
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        pb, pw, pc = bias, w, c
        bias = vb - g.sum() / scale_b
        w = vw - (np.bincount(feature, g[row], width) + ridge * vw) / scale_w
        c = vc - (before.T @ g + ridge * vc) / scale_c
    return Linear(float(bias), w, c)


@dataclass
class Chain:
    """Fitted models in order, over one sorted list of features."""

    names: list[str]
    wanted: np.ndarray
    models: list[Linear]
    out_of_fold: np.ndarray | None = None

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        row, feature = features(data, offs, self.wanted)
        out = np.zeros((n, len(self.names)))
        for k, model in enumerate(self.models):
            out[:, k] = model.probability(row, feature.astype(np.int64), n, _logit(out[:, :k]))
        return out


def _choose(pos: np.ndarray, seen: np.ndarray, n_pos: int, n: int) -> np.ndarray:
    """Features with the largest likelihood ratio between their and the overall rate."""
    if not n_pos or n_pos == n:
        return np.zeros(len(pos), bool)
    p = n_pos / n
    neg = seen - pos
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(pos > 0, pos * np.log(pos / (seen * p)), 0) + np.where(neg > 0, neg * np.log(neg / (seen * (1 - p))), 0)
    gain[(pos < SUPPORT) | (pos < p * seen)] = 0
    out = np.zeros(len(pos), bool)
    top = np.argsort(-gain, kind="stable")[:CHOSEN]
    out[top[gain[top] > 3.0]] = True
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches whose second column is text, about a CHUNK of it at a time."""
    for batch in batches:
        data, offs = K.text_column(batch.column(1))
        for a, b in K.slices(data, offs, K.CHUNK):
            yield batch.slice(a, b - a)
            K.release()


def fit(docs: DataFrame, labels: DataFrame, names: list[str], rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Chain:
    """`labels`: doc_id and one 0/1 column for each name, in the order of the chain.

    Of repeated labels of a document the greatest counts, and repeated documents count once.
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(x).cast("double")).alias(x) for x in names])
    drawn = F.xxhash64(F.col("doc_id"), F.lit("toxicity")) / F.lit(2.0**64) + 0.5
    told = told.filter(drawn <= min(1.0, rows / max(told.count(), 1)))  # about `rows` rows, so all tasks may get them
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(told), "doc_id")
    texts = texts.groupBy("doc_id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(texts.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).alias("fold"), *names), "labelled")
    share = size / max(sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1)
    if share < 1:
        sample = sample.filter(F.xxhash64(F.lit("bytes"), "doc_id") / F.lit(2.0**64) + 0.5 <= share)
    sample = sample.repartition(8, "doc_id")
    width = len(names)

    def label_matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([[np.nan if x is None else x for x in batch.column(3 + k).to_pylist()] for k in range(width)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct features with, for each fold, rows that have them: all, and by category."""
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in _sliced(batches):
            data, offs = K.text_column(batch.column(1))
            row, feature = features(data, offs)
            fold = batch.column(2).to_numpy().astype(np.int64)
            y = label_matrix(batch)
            names_, where = np.unique(feature, return_inverse=True)
            n = np.zeros((len(names_), 2 * width, FOLDS), np.int32)
            for k in range(width):
                known_ = ~np.isnan(y[k][row])
                n[:, 2 * k] = np.bincount(where * FOLDS + fold[row], known_, len(names_) * FOLDS).reshape(-1, FOLDS)
                n[:, 2 * k + 1] = np.bincount(where * FOLDS + fold[row], np.nan_to_num(y[k][row]), len(names_) * FOLDS).reshape(-1, FOLDS)
            held = (names_, n) if held is None else _merge([held, (names_, n)])
        if held is not None:
            ends = cut(held[0], SHARDS)
            blobs = [K.pack_all(K.deltas(held[0][a:b]), held[1][a:b].reshape(-1)) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        a, b = K.unpack_all(blob)
        return np.cumsum(a, dtype=np.uint64), b.astype(np.int32).reshape(-1, 2 * width, FOLDS)

    def add_up(group: pa.Table) -> pa.Table:
        """Sums of one shard of features; those too rare to be chosen go."""
        names_, n = _merge([unpacked(b) for b in group.column("blob").to_pylist()])
        often = (n[:, 1::2].sum(2) >= SUPPORT).any(1)
        return pa.table({"blob": pa.array([K.pack_all(K.deltas(names_[often]), n[often].reshape(-1))], pa.binary())})

    sums = sample.mapInArrow(count, "shard long, blob binary").groupBy("shard").applyInArrow(add_up, "blob binary")
    names_, n_ = _merge([unpacked(r.blob) for r in sums.collect()] or [(np.zeros(0, np.uint64), np.zeros((0, 2 * width, FOLDS), np.int32))])
    told = sample.select("doc_id", "fold", *names).collect()
    y = np.array([[np.nan if r[x] is None else r[x] for x in names] for r in told]).reshape(len(told), width)
    fold = np.array([r.fold for r in told], np.int64)
    chosen = np.zeros((width, FOLDS + 1, len(names_)), bool)  # without fold f; at FOLDS: with all
    for k in range(width):
        for f in range(FOLDS + 1):
            some = [x for x in range(FOLDS) if x != f]
            inside = np.isin(fold, some) & ~np.isnan(y[:, k])
            chosen[k, f] = _choose(n_[:, 2 * k + 1, some].sum(1), n_[:, 2 * k, some].sum(1), int(np.nansum(y[inside, k])), int(inside.sum()))
    any_ = chosen.any((0, 1))
    wanted, chosen = names_[any_], chosen[:, :, any_]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            data, offs = K.text_column(batch.column(1))
            row, feature = features(data, offs, wanted)
            blob = K.pack_all(batch.column(0).to_numpy().astype(np.uint64), row.astype(np.uint64), feature)
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    place = {r.doc_id: k for k, r in enumerate(told)}
    all_rows, all_features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in sample.mapInArrow(present, "blob binary").collect():
        ids, row, feature = K.unpack_all(r.blob)
        all_rows.append(np.array([place[int(i)] for i in ids.astype(np.int64)], np.int64)[row.astype(np.int64)])
        all_features.append(feature.astype(np.int64))
    row, feature = np.concatenate(all_rows), np.concatenate(all_features)
    models, oof = [], np.zeros((len(told), width))
    for k in range(width):
        before, known_ = _logit(oof[:, :k]), ~np.isnan(y[:, k])

        def on(some: np.ndarray, allowed: np.ndarray, k: int = k, before: np.ndarray = before) -> Linear:
            to = np.cumsum(some) - 1
            keep = some[row]
            return fit_linear(to[row[keep]], feature[keep], allowed, before[some], y[some, k])

        for f in range(FOLDS):
            model = on((fold != f) & known_, chosen[k, f])
            p = model.probability(row, feature, len(told), before)
            oof[fold == f, k] = p[fold == f]
        models.append(on(known_, chosen[k, FOLDS]))
    return Chain(names, wanted, models, oof)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([a for a, _ in parts])
    counts = np.concatenate([b for _, b in parts])
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    if not len(names):
        return names, counts
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    return names[first], np.add.reduceat(counts, first, axis=0)


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and the probability p_<name> of each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{x}" for x in chain.names]
    given = docs.select(*keep, *[F.col("text").alias("_scored")] * ("text" not in keep))  # no text goes to a worker twice
    at = keep.index("text") if "text" in keep else len(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in keep] + [f"{x} double" for x in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_column(batch.column(at))
            for a, b in K.slices(data, offs):
                p = shared.value.probabilities(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *(pa.array(p[:, k]) for k in range(len(added)))], [*keep, *added])
            del batch, data, offs
            K.release()

    return given.mapInArrow(run, schema)


def category_labels(labels: DataFrame) -> DataFrame:
    """The labels table as the chain's categories: low_quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ["low_quality", "toxic"]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",), rows: DataFrame | None = None) -> DataFrame:
    """Fit the chain low_quality -> toxic on `docs` with `labels`, and mark the documents
    whose toxic probability reaches `threshold`: columns in `keep` of `rows` (by default
    `docs`), p_low_quality, p_toxic, toxic."""
    chain = fit(docs, category_labels(labels), CATEGORIES)
    return score(docs if rows is None else rows, chain, keep).withColumn("toxic", F.col("p_toxic") >= threshold)
