"""Every registered ordering query agrees with its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave import property_queries, queries  # noqa: F401  (both register)
from rankweave.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    spark.catalog.clearCache()
    if name not in ORACLES:
        assert len(got)
        return
    want = db.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() == 1500


@pytest.mark.parametrize("n", [1500, 20_001])
def test_verified_sort_takes_all_orders(spark, tmp_path, n):
    """The largest load is that of all orders, also of those with large keys."""
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 1000).cast("double").alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["verified_sort"](spark, str(tmp_path)).collect()
    spark.catalog.clearCache()
    assert [tuple(r) for r in got] == [(True, True, (n + 7) // 8)]
