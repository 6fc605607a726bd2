"""Where intermediate tables live: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset.

    A cluster names a folder that the driver and all executors see.  Local
    sessions (tests) usually name none; there driver and executors are one
    machine, and a temporary folder is set for them.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="rankweave-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


#: Folders handed out that nobody has dropped yet, in the current scope.
_HANDED_OUT: ContextVar[list[str] | None] = ContextVar("handed_out", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """A list of the folders that are handed out inside, in this thread of control only."""
    made: list[str] = []
    token = _HANDED_OUT.set(made)
    try:
        yield made
    finally:
        _HANDED_OUT.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = _HANDED_OUT.get()
    if held is not None:
        held.append(path)
    return path


def table_name(path: str) -> str:
    """The catalog name of a bucketed table in a folder that was handed out."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate folders and the tables in them; only once every result that reads
    them is written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        spark.sql(f"drop table if exists {table_name(path)}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


#: Bytes of rows that go to a Python worker at a time, and Spark's own bound.
BATCH, BATCH_CONF, BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH, unless somebody has set them.

    An executor holds a batch in several copies outside its heap (vectors that grow by
    doubling, the buffer of the stream, the worker's own) for each of its cores.  Spark
    reads the setting when a plan runs, so it can't be undone when a stage is returned.
    """
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH)


#: Bytes of a row group that a task buffers before it writes.
ROW_GROUP = 32 << 20
#: Bytes of rows for which a file of its own is worth while.
FILE = 4 << 20


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back; lineage ends there.

    `most`: bytes that all rows have at most, where that is known.  Then no more files are
    written than these bytes want, however many partitions there are: for each file of a
    local folder Hadoop starts some processes (chmod) from the executor, each of which
    counts as a second executor in memory until it runs a program of its own.
    """
    path = new_path(df.sparkSession, name)
    df = df if most is None else df.coalesce(1 + most // FILE)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
