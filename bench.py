"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from rankweave import queries as Q
from rankweave.operators import sorters as S
from rankweave.sources import load
from rankweave.spec import SortSpec

LINE = SortSpec.by("l_extendedprice", ties=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
FLAG = SortSpec.by("l_returnflag", ties=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])


def _line(f):
    return lambda spark, d: f(load(spark, d, "lineitem"))


BENCH = {
    "orderby_lineitem": _line(lambda df: S.plain_sort(df, LINE)),
    "ams_lineitem": _line(lambda df: S.over_partition_sort(df, LINE, 8)),
    "ams_lineitem_ties": _line(lambda df: S.over_partition_sort(df, FLAG, 8)),
    "hss_lineitem": _line(lambda df: S.histogram_sort(df, LINE, 8)),
    "rlm_lineitem": _line(lambda df: S.select_sort(df, LINE, 8)),
    "janus_lineitem": _line(lambda df: S.balanced_sort(df, LINE, 8)),
    "rfis_lineitem": _line(lambda df: S.rank_sort(df, LINE, 8)),
    "rquick_lineitem": _line(lambda df: S.quick_sort(df, LINE, 8)),
    "bitonic_lineitem": _line(lambda df: S.packed_sort(df, LINE, size=100_000)),
} | {name: Q.QUERIES[name] for name in ("global_rank_orders", "splitters_equidistant", "running_totals", "last_flagged", "top_k", "merge_two_runs", "ams_bucket_histogram")}


def seconds(spark: SparkSession, f, sf_dir: str, runs: int = 2) -> float:
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        out: DataFrame = f(spark, sf_dir)
        out.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
        spark.catalog.clearCache()
    return round(statistics.median(took) if runs > 2 else min(took), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, BENCH["orderby_lineitem"], sf_dir, 1)
    times = {name: seconds(spark, f, sf_dir) for name, f in BENCH.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
