"""The corpus pipeline: documents through five operators, each stage written as Parquet.

Each stage works on all rows that the one before it kept.  The stages but the last
return the columns of documents, whatever other columns these have.

Defined results, for all stages: an empty table gives an empty one; rows without doc_id
stay rows of their own, and repeated rows are judged row by row, but for near-duplicates,
where of linked rows one stays.

The stages bound the bytes that go to a Python worker at a time, for the session they run
in, unless it has a bound of its own (``storage.bound_batches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankweave.llm import bpe, mixing, near_dedup, queries, substring_dedup, toxicity
from rankweave.llm.storage import bound_batches, drop, new_path, scope


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels table, finds toxic go.

    Null and empty texts have no features; they get the chain's intercepts, so they stay
    unless most labelled documents are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bound_batches(spark)
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    out = toxicity.classify(docs, labels, rows=rows, keep=("row", "text")).filter(~F.col("toxic"))
    return out.select([F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one with the least doc_id stays.

    Null and empty texts, and rows without doc_id, are linked with nothing and stay; of
    equal rows, and of rows of one doc_id that are linked, one stays; rows of one doc_id
    that are not linked all stay.
    """
    bound_batches(spark)
    return near_dedup.deduplicate(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller doc_id has go; n_chars follows the new text.

    Every row stays: a null text stays null, one that loses all words becomes empty.  Rows of
    one doc_id don't remove each other's words; no doc_id counts as the greatest.
    """
    bound_batches(spark)
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    out = substring_dedup.remove_repeats(rows, keep=("doc_id", "row"), with_text=True).select("row.*", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0 and share in their source's copies; a source without
    words gives nothing; a null source is a source; repeated rows count each.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids and digests of each text that the mix holds.

    Every row stays; null and empty texts have no tokens.
    """
    bound_batches(spark)
    return bpe.encode_columns(docs, queries.vocabulary_path(), keep=("doc_id", "source"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near-dedup", near_duplicates),
    ("substring-dedup", repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the trained classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; each one's rows are written and read
    again, and what it left in the shared folder goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scope() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        drop(spark, made)
        docs = spark.read.parquet(path)
    return docs
