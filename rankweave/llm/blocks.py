"""Blocks: a few megabytes of documents as one row, kept where their answers come back to.

Operators that ask the whole corpus about every word or window do so a block at a
time: a block sends its distinct questions, packed, to the shards that can answer
them, and gets packed answers back.  So hot words or passages cost one question a
block, and rows stay few.  The blocks lie in a table bucketed by block number:
answers are dealt out by the same number, and joining them moves no block.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rankweave.llm import kernels as K
from rankweave.llm.storage import new_path, table_name

#: Bytes of text that one block holds, one document at least.
BLOCK_BYTES = 3 << 20


#: Stands for a null doc_id: it comes after all others.
NO_ID = (1 << 63) - 1


def doc_ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def _new_number() -> int:
    return uuid.uuid4().int >> 66  # 62 bits


def to_rows(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue()


def from_rows(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_all().combine_chunks().to_batches()[0]


class Blocks:
    """The bucketed table of blocks and its numbers."""

    def __init__(self, docs: DataFrame, describe: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], tuple[bytes, list[int], int]], block_bytes: int | None = None) -> None:
        """Writes the rows of `docs` (whose last column is text) as blocks.

        `describe` gets bytes, offsets and rows of a block, and returns what is kept as
        its ``body``, some longs kept as ``marks``, and its size in questions.
        """
        self.spark = docs.sparkSession
        block_bytes = block_bytes or BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = K.text_column(batch.column(batch.num_columns - 1))
                for a, b in K.slices(data, offs, block_bytes):
                    rows = batch.slice(a, b - a)
                    body, marks, size = describe(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], rows)
                    columns = [pa.array([_new_number()], pa.int64()), pa.array([body], pa.binary()), pa.array([marks], pa.list_(pa.int64())), pa.array([size], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "body", "marks", "size"])
                    K.release()

        size = docs.agg(F.sum(F.octet_length(docs.columns[-1]))).first()[0] or 0
        self.buckets = max(4, min(100_000, int(size) // (2 * block_bytes)))
        path = new_path(self.spark, "blocks")
        self.name = table_name(path)  # goes when the path is dropped
        made = docs.mapInArrow(run, "block long, body binary, marks array<long>, size long")
        made.write.bucketBy(self.buckets, "block").option("path", path).option("compression", "none").saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def size(self) -> int:
        return self.table.agg(F.sum("size")).first()[0] or 0

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """block, body, marks and for each of the `answers` (block, shard, blob) the list of
        (shard, blob) that belongs to the block."""
        out = self.table.select("block", "body", "marks")
        for k, each in enumerate(answers):
            dealt = each.repartition(self.buckets, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "blob")).alias(f"answers{k}"))
            out = out.join(dealt.hint("merge"), "block", "left")
        return out

    def ask(self, questions: Callable[[dict], Iterator[tuple[int, bytes]]], *answers: DataFrame) -> DataFrame:
        """shard, block, blob: what each block asks, given the `answers` so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                    asked = list(questions(row))
                    columns = [pa.array([s for s, _ in asked], pa.int64()), pa.array([row["block"]] * len(asked), pa.int64()), pa.array([b for _, b in asked], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "blob"])
                    K.release()

        return self.with_answers(*answers).mapInArrow(run, "shard long, block long, blob binary")


#: Reduce tasks of one exchange at most; beyond it a task takes several shards, one at a time.
MOST_TASKS = 20_000


def answered(questions: DataFrame, answer: Callable[[int, list[bytes]], list[bytes]], shards: int) -> DataFrame:
    """block, shard, blob: the answers of each shard to its questions, one for each."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = group.column("shard")[0].as_py()
        blobs = answer(shard, group.column("blob").to_pylist())
        K.release()
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "blob": pa.array(blobs, pa.binary())})

    return questions.repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInArrow(run, "block long, shard long, blob binary")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of uint64 keys, if shards are equal ranges; ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def runs(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of each shard that occurs in an ascending list."""
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(first, len(shard))[1:]
    return list(zip(shard[first].tolist(), first.tolist(), ends.tolist(), strict=True))


def cut(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each of a fixed number of shards' part of sorted uint64 keys begins."""
    return np.searchsorted(shard_of(sorted_keys, shards), np.arange(shards + 1))
