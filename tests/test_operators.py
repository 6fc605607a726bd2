"""Sorters and prefix operators on adversarial inputs, by the properties they promise."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankweave.operators import exchange as X
from rankweave.operators import merge as M
from rankweave.operators import rank as R
from rankweave.operators import sampling as A
from rankweave.operators import scan as C
from rankweave.operators import sorters as S
from rankweave.operators import splitters as P
from rankweave.operators import verify as V
from rankweave.operators.cutsearch import with_place
from rankweave.spec import SortSpec

SPEC = SortSpec.by("key", ties=["id"])


def frame(spark, keys, parts=3, kind="int"):
    rows = [(k, i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, f"key {kind}, id long").repartition(parts)


def inputs():
    rng = random.Random(4)
    yield "empty", []
    yield "one", [5]
    yield "equal", [7] * 90
    yield "sorted", list(range(70))
    yield "reversed", list(range(70, 0, -1))
    yield "zipf", [int(1 / (rng.random() + 0.01)) for _ in range(150)]
    yield "nulls", [None, 3, None, 1, 2, None, 3] * 9


CASES = [pytest.param(k, id=n) for n, k in inputs()]


def expected(keys, falling=False):
    order = sorted(((k is not None, k or 0), i) for i, k in enumerate(keys))
    return [i for _, i in order]


@pytest.mark.parametrize("keys", CASES)
@pytest.mark.parametrize("p", [1, 3, 5])
def test_balanced_and_rank_sorts(spark, keys, p):
    df = frame(spark, keys)
    out = S.balanced_sort(df, SPEC, p).cache()
    assert [r.id for r in out.orderBy("rank").collect()] == expected(keys)
    assert [r.rank for r in out.orderBy("rank").collect()] == list(range(len(keys)))
    loads = V.loads(out, p)
    assert max(loads) - min(loads) <= 1 and sum(loads) == len(keys)
    assert V.is_sorted(out, SPEC) and V.nothing_lost(df, out)
    out.unpersist()


@pytest.mark.parametrize("keys", CASES)
def test_bounded_sorts(spark, keys):
    df = frame(spark, keys)
    for sort in (S.over_partition_sort, S.histogram_sort, S.select_sort):
        out = sort(df, SPEC, 4).cache()
        assert V.is_sorted(out, SPEC), sort
        assert V.nothing_lost(df, out), sort
        assert max(V.loads(out, 4)) <= math.ceil(1.10 * math.ceil(len(keys) / 4)) + 1, (sort, V.loads(out, 4))
        assert out.filter(F.col("pid") != F.spark_partition_id()).isEmpty()
        out.unpersist()


def test_whole_buckets_keep_equal_keys_together(spark):
    df = frame(spark, [1] * 50 + [2] * 50 + [3] * 5)
    out = S.over_partition_sort(df, SortSpec.by("key"), 4, equal_buckets=False)
    assert out.select("key", "pid").distinct().groupBy("key").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("keys", CASES)
def test_equal_keys_without_ties_are_cut_at_exact_places(spark, keys):
    df, spec = frame(spark, keys), SortSpec.by("key")
    out = S.over_partition_sort(df, spec, 4).cache()
    assert V.is_sorted(out, spec) and V.nothing_lost(df, out)
    assert max(V.loads(out, 4)) <= math.ceil(1.10 * math.ceil(len(keys) / 4)) + 1
    out.unpersist()


def test_cut_search(spark):
    """Places among cuts agree with counting, for nulls, NaN, both directions, several keys and types."""
    rng = random.Random(2)
    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.5, 1.0, 2.5]
    rows = [(rng.choice(values), rng.choice([None, "a", "b'\\", "\u00e9"]), k) for k in range(120)]
    df = spark.createDataFrame(rows, "x double, s string, id long")
    for spec in (SortSpec.by("x", "s desc", ties=["id"]), SortSpec.by("x desc", "s"), SortSpec.by("s")):
        place_of = spec.sort_key()
        keys = {r.id: tuple(r)[1:] for r in df.select("id", *spec.values()).collect()}
        for n in (0, 1, 2, 6, 7, 8, 40):
            cuts = sorted(rng.sample(list(keys.values()), n), key=place_of)
            cuts = [c for k, c in enumerate(cuts) if not k or place_of(cuts[k - 1]) < place_of(c)]
            for r in with_place(df, spec.total, cuts, "n", same="same").collect():
                at = place_of(keys[r.id])
                assert r.n == sum(place_of(c) <= at for c in cuts)
                assert r.same == any(not place_of(c) < at and not at < place_of(c) for c in cuts)
    kinds = df.filter("id < 50").select("id", F.timestamp_micros(F.col("id") * 1_000_003).alias("t"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.col("id") / 7).cast("decimal(20,4)").alias("m"), F.col("id").cast("string").cast("binary").alias("b"))
    for name in "tdmb":
        cut = kinds.orderBy(name).select(name).collect()[20][0]
        placed = with_place(kinds, SortSpec.by(name).keys, [(cut,)], "n", same="same")
        assert placed.filter("same").count() == 1 and placed.filter("n = 0").count() == 20


def test_many_cuts_stay_small_plans(spark):
    """Twenty thousand cuts in fifteen steps; filters stay above the search."""
    cuts = [(k,) for k in range(20_000)]
    df = with_place(spark.range(0, 20_000, 7), SortSpec.by("id").keys, cuts, "n")
    assert df.filter("n = id + 1").count() == len(range(0, 20_000, 7))
    rows = S.over_partition_sort(spark.range(3000).select(F.hash("id").alias("key"), "id"), SPEC, 100).collect()
    assert [r.id for r in rows] == [r.id for r in sorted(rows, key=lambda r: (r.key, r.id))]
    assert max(Counter(r.pid for r in rows).values()) <= 33


@pytest.mark.parametrize("keys", CASES)
def test_power_of_two_and_packed(spark, keys):
    df = frame(spark, keys)
    for robust in (True, False):
        out = S.quick_sort(df, SPEC, 7, robust).cache()
        assert V.is_sorted(out, SPEC) and V.nothing_lost(df, out)
        assert all(r.pid < 4 for r in out.collect())
        out.unpersist()
    packed = S.packed_sort(df, SPEC, size=16)
    assert all(r.pid == r["rank"] // 16 for r in packed.collect())
    small = S.rank_sort(df, SPEC, 3)
    assert {r.pid for r in small.collect()} <= {0}


def test_one_each_and_its_limit(spark):
    df = frame(spark, [3, 1, 2, 1])
    assert [(r.key, r.pid) for r in S.one_each(df, SPEC).orderBy("pid").collect()] == [(1, 0), (1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        R.small_rank(df, SPEC, most=3)


def test_descending_nan_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 1), (None, 2), (-0.0, 3), (7.5, 4)], "key double, id long")
    down = R.global_rank(df, SortSpec.by("key desc", ties=["id"]), 3).orderBy("rank")
    assert [r.id for r in down.collect()] == [1, 4, 0, 3, 2]
    up = R.global_rank(df, SPEC, 3).orderBy("rank")
    assert [r.id for r in up.collect()] == [2, 3, 0, 4, 1]


def test_struct_string_and_timestamp_keys(spark):
    rows = [(("b", 1), i) for i in range(3)] + [(("a", 9), 7)]
    df = spark.createDataFrame(rows, "key struct<x: string, y: int>, id long")
    assert [r.id for r in R.global_rank(df, SPEC).orderBy("rank").collect()] == [7, 0, 1, 2]
    stamped = df.withColumn("key", F.to_timestamp(F.concat(F.lit("2020-01-0"), (F.col("id") + 1).cast("string"))))
    cuts = R.boundaries(stamped, SPEC, 2, eps=0.0)
    assert cuts[0].rank == 2 and cuts[0].at[1] == 2


@pytest.mark.parametrize("samples", [1, 5])
@pytest.mark.parametrize("pool", [1, 128])
def test_exact_cuts_with_ties(spark, samples, pool):
    keys, done = [1] * 40 + [2] * 3 + [5] * 57, R.Search()
    cuts = R.multi_select(frame(spark, keys), SPEC, [20, 40, 60, 80, 100], samples=samples, pool=pool, done=done)
    assert [c.rank for c in cuts] == [20, 40, 60, 80, 100] and done.rounds > 0
    assert [c.at for c in cuts] == [*[(keys[r], r) for r in (20, 40, 60, 80)], None]


@pytest.mark.parametrize("samples", [1, 5])
def test_cuts_stay_within_their_slack_or_raise(spark, samples):
    df, done = frame(spark, [k * 7919 % 1000 for k in range(1000)]), R.Search()
    cuts = R.boundaries(df, SPEC, 8, eps=0.1, samples=samples, done=done)
    assert all(abs(c.rank - 125 * (k + 1)) <= 6 for k, c in enumerate(cuts)) and done.rounds > 0
    if samples == 1:
        assert done.pivots <= 7 * done.rounds
    with pytest.raises(RuntimeError):
        R.multi_select(df, SPEC, [10, 500], samples=1, rounds=1)


def test_equal_keys_without_ties_give_the_cut_before_them(spark):
    cuts = R.multi_select(frame(spark, [1] * 40 + [2] * 3 + [5] * 57), SortSpec.by("key"), [20, 41, 60])
    assert [(c.rank, c.at) for c in cuts] == [(0, (1,)), (40, (2,)), (43, (5,))]


def test_bitonic(spark):
    parts = [(0, 1), (0, 1), (0, 1), (1, 0), (1, 1), (1, 1), (2, 1), (2, 1), (2, 1)]
    df = spark.createDataFrame([(p, v, i) for i, (p, v) in enumerate(parts)], "part int, key int, id long")
    assert M.is_bitonic(df, F.col("part"), SortSpec.by("key")) is True
    rising_then_falling = spark.createDataFrame([(0, 1, 0), (1, 5, 1), (2, 2, 2)], "part int, key int, id long")
    assert M.is_bitonic(rising_then_falling, F.col("part"), SortSpec.by("key")) is False
    out = S.merge_bitonic(df.filter("part = 0"), df.filter("part > 0"), SPEC, size=3)
    assert [r.key for r in out.orderBy("rank").collect()] == [0] + [1] * 8
    down = S.merge_bitonic(df.filter("part = 0"), df.filter("part > 0"), SPEC, size=3, increasing=False)
    assert [r.key for r in down.filter("pid = 2").collect()] == [0, 1, 1]


def test_nearest_preceding_flag(spark):
    flags = [1, 0, 0, 1, 0, 0, 1, 0]
    df = spark.createDataFrame([(i, f, i) for i, f in enumerate(flags)], "at int, flag int, el int")
    out = C.last_flagged(df, SortSpec.by("at"), F.col("flag") == 1, "el", partitions=4)
    assert [r.prev_flagged for r in out.orderBy("at").collect()] == [0, 0, 0, 0, 3, 3, 3, 6]


def test_running_total_with_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "at int, v long")
    out = C.running_total(df, SortSpec.by("at"), "v", partitions=3).orderBy("at").collect()
    assert [(r.exscan, r.scan, r.total) for r in out] == [(0, 5, 12), (5, 5, 12), (5, 12, 12)]
    assert C.running_total(df.limit(0), SortSpec.by("at"), "v").isEmpty()


def test_splitters_and_buckets(spark):
    assert P.splitter_ranks(16, 3) == [4, 8, 12]
    df = frame(spark, [1, 2, 2, 3, 9])
    got = {r.bucket: r.cnt for r in P.histogram(P.with_bucket(df, SortSpec.by("key").keys, [(2,), (3,)])).collect()}
    assert got == {0: 1, 1: 2, 3: 1, 4: 1}
    assert {r.bucket for r in P.with_bucket(df, SortSpec.by("key").keys, []).collect()} == {0}
    assert [r.value for r in P.distinct_splitters(df.select(F.col("key").alias("value"))).orderBy("value").collect()] == [1, 2, 3, 9]


def test_samples(spark):
    df = frame(spark, list(range(100)), parts=5)
    drawn = A.uniform(df, 300, seed=3)
    assert drawn.count() == 300 and drawn.distinct().count() <= 100
    assert A.uniform(df.limit(0), 10, seed=3).isEmpty()
    assert A.bernoulli(df, 1.5, seed=1).count() == 100
    assert A.bernoulli(df, 0.5, seed=1, windows=F.col("key") < 10).filter("key >= 10").isEmpty()
    assert A.quotas(df, 50, 1, F.col("key") % 3).agg(F.sum("quota")).first()[0] == 50
    one = A.one_of_each_range(R.ranked(df, SPEC), [(0, 50), (50, 100), (7, 7)], seed=2)
    assert one.count() == 2


def test_reusable_sorter_and_metrics(spark):
    df = frame(spark, list(range(50)))
    sorter = S.Sorter(SPEC, 4)
    assert V.loads(sorter.sort(df), 4) == [13, 13, 12, 12]
    assert [r.key for r in sorter.sort_range(df, 10, 8).orderBy("rank").collect()] == list(range(10, 18))
    assert {"total", "range"} <= set(sorter.timers) and sorter.depth == 1
    told = S.SortMetrics()
    S.quick_sort(df, SPEC, 4, metrics=told), S.balanced_sort(df, SPEC, 4, metrics=told), S.histogram_sort(df, SPEC, 4, metrics=told)
    assert {"exchange", "partition", "splitters"} <= set(told.seconds) and told.counts["rounds"] > 0


def test_layouts_are_released(spark):
    spark.catalog.clearCache()
    with C.layouts():
        assert R.global_rank(frame(spark, [3, 1, 2]), SPEC).count() == 3
        assert spark.sparkContext._jsc.getPersistentRDDs()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_exchanges(spark):
    df = frame(spark, list(range(40)))
    out = X.to_partition(df.withColumn("pid", F.col("key") % 4), "pid", 4, SPEC)
    assert out.filter(F.spark_partition_id() != F.col("pid")).isEmpty()
    assert V.nothing_lost(df, X.shuffled(df, 5, 1)) and X.folded(df.repartition(6), 6).rdd.getNumPartitions() == 4


def test_verification_finds_faults(spark):
    df = frame(spark, [1, 2, 3]).coalesce(1)
    assert not V.is_sorted(df.orderBy(F.desc("key")).coalesce(1), SortSpec.by("key"))
    assert not V.nothing_lost(df, df.filter("key < 3"))
    assert not V.nothing_lost(df, df.unionByName(df.filter("key = 1")))
    assert V.covers([(0, 3), (3, 5)], 5) and not V.covers([(0, 3), (2, 5)], 5)


def test_stripes_overlap(spark):
    x = spark.createDataFrame([(1, 4), (2, 0), (3, 6)], "i int, n long")
    y = spark.createDataFrame([(1, 3), (2, 3), (3, 9)], "j int, m long")
    got = M.stripe_overlaps(x, y, "i", "j", "n", "m").orderBy("x", "y").collect()
    assert [tuple(r) for r in got] == [(1, 1, 3), (1, 2, 1), (3, 2, 2), (3, 3, 4)]
