"""Inputs: the tables a query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
