"""Registered queries over the ordering operators, each with the SQL it must agree with.

The comparison ignores row order, so order is returned as data: ranks, partitions
and prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankweave.functions import bucket_of, offset_in_slot
from rankweave.operators import exchange as X
from rankweave.operators import merge as M
from rankweave.operators import rank as R
from rankweave.operators import sampling as A
from rankweave.operators import scan as C
from rankweave.operators import sorters as S
from rankweave.operators import splitters as P
from rankweave.operators import verify as V
from rankweave.registry import ORACLES, QUERIES, query  # noqa: F401
from rankweave.sources import load
from rankweave.spec import SortSpec

PRICE = SortSpec.by("o_totalprice", ties=["o_orderkey"])
DEAR = SortSpec.by("o_totalprice desc", ties=["o_orderkey"])
TIME = SortSpec.by("ts", ties=["event_id"])
TYPE = SortSpec.by("event_type", ties=["event_id"])
P8 = 8

_RANKED = "row_number() over (order by o_totalprice nulls first, o_orderkey) - 1"
_EVEN = "case when n // 8 = 0 then r when r < (n % 8) * (n // 8 + 1) then r // (n // 8 + 1) else n % 8 + (r - (n % 8) * (n // 8 + 1)) // (n // 8) end"


# -- ranks

@query(f"select o_orderkey, o_totalprice, {_RANKED} as rank from orders")
def global_rank_orders(spark, sf_dir):
    return R.global_rank(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), PRICE)


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc nulls last, o_orderkey) - 1 as rank from orders")
def rank_desc_orders(spark, sf_dir):
    return R.global_rank(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), DEAR)


@query("select event_id, event_type, row_number() over (order by event_type nulls first, event_id) - 1 as rank, count(*) over () as n from events")
def rank_and_count_events(spark, sf_dir):
    return R.rank_and_count(load(spark, sf_dir, "events").select("event_id", "event_type"), TYPE)


@query(
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, row_number() over (order by l_quantity nulls first, l_extendedprice, l_orderkey,"
    " l_partkey, l_suppkey, l_linenumber) - 1 as rank from lineitem"
)
def rank_lineitem_heavy_ties(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return R.global_rank(rows, SortSpec.by("l_quantity", ties=["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))


@query("select n_nationkey, n_name, row_number() over (order by n_name, n_nationkey) - 1 as rank, row_number() over (order by n_name, n_nationkey) - 1 as pid from nation")
def mini_sort_nation(spark, sf_dir):
    out = S.one_each(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), SortSpec.by("n_name", ties=["n_nationkey"]))
    return out.withColumn("pid", F.col("pid").cast("long"))


@query("select count(*) filter (where l_quantity < 25) as lower_bound, count(*) filter (where l_quantity <= 25) as upper_bound from lineitem")
def bounds_quantity(spark, sf_dir):
    return R.bounds(load(spark, sf_dir, "lineitem"), SortSpec.by("l_quantity"), (25.0,))


@query(
    "with b as (select 1 as source, o_orderkey, o_totalprice from orders where o_orderstatus = 'F' union all select 2, o_orderkey, o_totalprice from orders where o_orderstatus <> 'F'),"
    " r as (select *, row_number() over (order by o_totalprice nulls first, source, o_orderkey) - 1 as rank from b) select * from r where rank < 1000"
)
def two_sequence_selection(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    one, two = X.split_by(orders, F.col("o_orderstatus") == "F")
    return R.split_at_rank(one.select("o_orderkey", "o_totalprice"), two.select("o_orderkey", "o_totalprice"), PRICE, 1000)


@query("select quantile_disc(o_totalprice, 0.5) as median from orders")
def median_exact(spark, sf_dir):
    return R.median(load(spark, sf_dir, "orders"), "o_totalprice")


def _cuts(spark, cuts):
    return spark.createDataFrame([(i + 1, c.rank, *c.at) for i, c in enumerate(cuts)], "i int, rank long, o_totalprice double, o_orderkey long")


_CUT_SQL = (
    f"with r as (select o_orderkey, o_totalprice, {_RANKED} as rank, count(*) over () as n from orders), g as (select unnest(range(1, 8)) as i)"
    " select g.i::int as i, r.rank, r.o_totalprice, r.o_orderkey from g join r on r.rank = g.i * r.n // 8"
)


@query(_CUT_SQL)
def hss_boundaries(spark, sf_dir):
    return _cuts(spark, R.boundaries(load(spark, sf_dir, "orders"), PRICE, P8, eps=0.0, samples=5))


@query(_CUT_SQL)
def rlm_boundaries(spark, sf_dir):
    return _cuts(spark, R.boundaries(load(spark, sf_dir, "orders"), PRICE, P8, eps=0.0, samples=1))


# -- sorts and their placement

@query(f"with r as (select o_orderkey, {_RANKED} as r, count(*) over () as n from orders) select o_orderkey, r as rank, ({_EVEN})::int as pid from r")
def janus_place_orders(spark, sf_dir):
    return S.balanced_sort(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), PRICE, P8).select("o_orderkey", "rank", "pid")


@query(f"with r as (select o_orderkey, {_RANKED} as rank, count(*) over () as n from orders) select o_orderkey, rank, (rank // ((n + 3) // 4))::int as pid from r")
def rfis_place_orders(spark, sf_dir):
    return S.rank_sort(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), PRICE, 7).select("o_orderkey", "rank", "pid")


@query(f"with r as (select o_orderkey, {_RANKED} as rank from orders) select o_orderkey, rank, (rank // 700)::int as pid from r")
def bitonic_place_orders(spark, sf_dir):
    return S.packed_sort(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), PRICE, size=700).select("o_orderkey", "rank", "pid")


@query(f"with r as (select o_orderkey, {_RANKED} as rank from orders) select o_orderkey, rank, (rank // 1000)::int as pid from r")
def bitonic_sequence_orders(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    low, high = X.split_by(orders, F.col("o_totalprice") < 50000)
    return S.merge_bitonic(low.orderBy(F.desc("o_totalprice")), high.orderBy("o_totalprice"), PRICE, size=1000).select("o_orderkey", "rank", "pid")


def _with_rank(sorted_df: DataFrame, spec: SortSpec, *columns: str) -> DataFrame:
    """Ranks read off the partitions of a sorted frame, in which no row moves any more."""
    laid = sorted_df.withColumn(C.PID, F.col("pid")).withColumn(C.AT, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    laid = C.kept(laid)
    base = C.exclusive(C.partition_counts(laid, C.PID))
    return C._carry(laid, base, "_base", "long").withColumn("rank", F.col("_base") + F.col(C.AT)).select(*columns, "rank")


_TIME_SQL = "select event_id, row_number() over (order by ts nulls first, event_id) - 1 as rank from events"
_TYPE_SQL = "select event_id, event_type, row_number() over (order by event_type nulls first, event_id) - 1 as rank from events"


@query(_TYPE_SQL)
def ams_sort_events(spark, sf_dir):
    return _with_rank(S.over_partition_sort(load(spark, sf_dir, "events").select("event_id", "event_type"), TYPE, P8), TYPE, "event_id", "event_type")


@query(_TIME_SQL)
def hss_sort_events(spark, sf_dir):
    return _with_rank(S.histogram_sort(load(spark, sf_dir, "events").select("event_id", "ts"), TIME, P8), TIME, "event_id")


@query(_TIME_SQL)
def rlm_sort_events(spark, sf_dir):
    return _with_rank(S.select_sort(load(spark, sf_dir, "events").select("event_id", "ts"), TIME, P8), TIME, "event_id")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc nulls last, o_orderkey) - 1 as rank from orders")
def rquick_sort_orders(spark, sf_dir):
    return _with_rank(S.quick_sort(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), DEAR, P8), DEAR, "o_orderkey", "o_totalprice")


@query("select v, row_number() over (order by v) - 1 as rank from (select distinct struct_pack(v := o_totalprice) as s, o_totalprice as v from orders)")
def struct_sort_orders(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.struct(F.col("o_totalprice").alias("v")).alias("s")).distinct()
    return R.global_rank(rows, SortSpec.by("s.v")).select("s.v", "rank")


@query(f"with r as (select o_orderkey, {_RANKED} as r, count(*) over () as n from orders), s as (select o_orderkey, r as rank, r - 100 as r, count(*) over () as n from r where r between 100 and 5099) select o_orderkey, rank, ({_EVEN})::int as pid from s")
def sorter_range_orders(spark, sf_dir):
    sorter = S.Sorter(PRICE, P8)
    return sorter.sort_range(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, 5000).select("o_orderkey", "rank", "pid")


# -- splitters, buckets, histograms

@query(f"with r as (select o_orderkey, o_totalprice, {_RANKED} as rank, count(*) over () as n from orders), g as (select unnest(range(1, 16)) as i) select g.i::int as i, rank, o_orderkey, o_totalprice from g join r on rank = g.i * n // 16")
def splitters_equidistant(spark, sf_dir):
    return P.equidistant(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), PRICE, 15)


_Q = [(10.0,), (20.0,), (25.0,), (40.0,)]


@query("select (2 * ((l_quantity > 10)::int + (l_quantity > 20)::int + (l_quantity > 25)::int + (l_quantity > 40)::int) + (l_quantity in (10, 20, 25, 40))::int)::int as bucket, count(*) as cnt from lineitem group by 1")
def ams_bucket_histogram(spark, sf_dir):
    return P.histogram(P.with_bucket(load(spark, sf_dir, "lineitem"), SortSpec.by("l_quantity").keys, _Q))


@query("select ((l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 25)::int + (l_quantity >= 40)::int)::int as bucket, count(*) as cnt from lineitem group by 1")
def plain_bucket_histogram(spark, sf_dir):
    return P.histogram(P.with_bucket(load(spark, sf_dir, "lineitem"), SortSpec.by("l_quantity").keys, _Q, equal_buckets=False))


@query(
    "with c as (select (o_orderkey % 8)::int as part, (2 * ((o_orderpriority > '2-HIGH')::int) + (o_orderpriority = '2-HIGH')::int)::int as bucket, count(*) as cnt from orders group by 1, 2)"
    " select *, coalesce(sum(cnt) over (partition by bucket order by part rows between unbounded preceding and 1 preceding), 0)::bigint as exscan,"
    " (sum(cnt) over (partition by bucket order by part))::bigint as scan, (sum(cnt) over (partition by bucket))::bigint as total from c"
)
def partition_exscan(spark, sf_dir):
    orders = P.with_bucket(load(spark, sf_dir, "orders"), SortSpec.by("o_orderpriority").keys, [("2-HIGH",)])
    return P.partition_histogram(orders, (F.col("o_orderkey") % 8).cast("int"))


@query("select distinct l_discount as value from lineitem")
def dedup_splitters(spark, sf_dir):
    return P.distinct_splitters(load(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("value")))


@query("select bucket, count(*) as cnt from (select ((o_totalprice >= 1000)::int + (o_totalprice >= 20000)::int + (o_totalprice >= 60000)::int)::int as bucket from orders) group by 1")
def searched_buckets(spark, sf_dir):
    return P.histogram(load(spark, sf_dir, "orders"), bucket_of(F.col("o_totalprice"), [1000.0, 20000.0, 60000.0]))


@query("select o_orderkey, o_orderkey % 3 = 0 as chosen, row_number() over (partition by o_orderkey % 3 = 0 order by o_orderdate, o_orderkey) - 1 as place from orders")
def stable_partition(spark, sf_dir):
    """Both sides keep the order that the rows had before."""
    order = SortSpec.by("o_orderdate", ties=["o_orderkey"])
    rows = R.global_rank(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), order)
    sides = X.split_by(rows, F.col("o_orderkey") % 3 == 0)
    yes, no = (R.global_rank(side.withColumnRenamed("rank", "was"), SortSpec.by("was")).withColumn("chosen", F.lit(k == 0)) for k, side in enumerate(sides))
    return yes.unionByName(no).select("o_orderkey", "chosen", F.col("rank").alias("place"))


# -- merging

@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as rank from (select * from orders order by o_totalprice, o_orderkey limit 100)")
def bottom_k(spark, sf_dir):
    halves = X.split_by(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") % 2 == 0)
    return R.small_rank(M.first_of(list(halves), PRICE, 100), PRICE)


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey desc) - 1 as rank from (select * from orders order by o_totalprice desc, o_orderkey desc limit 100)")
def top_k(spark, sf_dir):
    halves = X.split_by(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") % 2 == 0)
    return R.small_rank(M.last_of(list(halves), PRICE, 100), M.reversed_spec(PRICE))


@query("with b as (select o_custkey as k, o_orderkey as id, 0 as source from orders union all select c_custkey, c_custkey, 1 from customer) select *, row_number() over (order by k, source, id) - 1 as rank from b")
def merge_two_runs(spark, sf_dir):
    one = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    two = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"))
    return M.merge_runs([one, two], SortSpec.by("k", ties=["id"]))


@query(
    "with x as (select p_partkey as x, sum(p_size) over (order by p_partkey) - p_size as a, sum(p_size) over (order by p_partkey) as b from part),"
    " y as (select s_suppkey as y, sum(s_nationkey * 37 + 1) over (order by s_suppkey) - (s_nationkey * 37 + 1) as a, sum(s_nationkey * 37 + 1) over (order by s_suppkey) as b from supplier)"
    " select x, y, (least(x.b, y.b) - greatest(x.a, y.a))::bigint as size from x join y on x.a < y.b and y.a < x.b where x.b > x.a and y.b > y.a"
)
def interval_overlap(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"))
    y = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 37 + 1).alias("size"))
    return M.stripe_overlaps(x, y, "p_partkey", "s_suppkey", "size", "size")


# -- exchanges

@query("with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as rank, count(*) over (partition by o_orderstatus) as n from orders) select o_orderkey, o_orderstatus, rank, (case when rank < (n % 3) * (n // 3 + 1) then rank // (n // 3 + 1) else n % 3 + (rank - (n % 3) * (n // 3 + 1)) // (n // 3) end)::bigint as slot from r")
def even_split_in_group(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    ranked = R.ranked(orders, SortSpec.by("o_orderstatus", ties=["o_orderkey"])).df
    groups = ranked.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("rank").alias("first")).withColumn("slots", F.lit(3).cast("long"))
    inner = ranked.join(groups.select("o_orderstatus", "first"), "o_orderstatus").withColumn("rank", F.col("rank") - F.col("first")).drop("first")
    return X.even_in_group(inner, "o_orderstatus", "rank", groups.select("o_orderstatus", "n", "slots"), "slots", "n")


@query("select count(*) as n, sum(o_orderkey)::bigint as keys, count(distinct o_orderkey) as one_each, true as even from orders")
def random_shuffle(spark, sf_dir):
    """All rows once, and loads within six standard deviations of even."""
    out = X.shuffled(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), P8, 3).withColumn("landed", F.spark_partition_id())
    loads = out.groupBy("landed").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_orderkey").alias("one_each"))
    n = F.sum("n")
    even = (F.max("n") <= n / P8 + 6 * F.sqrt(n / P8)) & (F.min("n") >= n / P8 - 6 * F.sqrt(n / P8)) & (F.count("*") == P8)
    return loads.agg(n.alias("n"), F.sum("keys").alias("keys"), F.sum("one_each").alias("one_each"), even.alias("even"))


@query("select o_orderkey, (o_orderkey % 8)::int as pid, (o_orderkey % 8)::int as landed from orders")
def exchange_by_id(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).cast("int").alias("pid"))
    return X.to_partition(rows, "pid", P8).withColumn("landed", F.spark_partition_id())


@query(f"with r as (select o_orderkey, {_RANKED} as r, count(*) over () as n from orders) select o_orderkey, ({_EVEN})::int as pid, (r - min(r) over (partition by {_EVEN}))::bigint as place from r")
def even_split_arithmetic(spark, sf_dir):
    r = R.ranked(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), PRICE)
    return r.df.select("o_orderkey", X.even_pid(r.n, P8).alias("pid"), offset_in_slot(F.col("rank"), r.n, P8).alias("place"))


# -- collectives

@query("select sum(l_quantity) as sum_qty, max(l_extendedprice) as max_price, count(*) as n, bit_and(l_linenumber) as all_bits, bit_or(l_linenumber) as any_bits from lineitem")
def sum_max_fused(spark, sf_dir):
    return C.reduce_all(
        load(spark, sf_dir, "lineitem"), sum_qty=F.sum("l_quantity"), max_price=F.max("l_extendedprice"), n=F.count("*"), all_bits=F.bit_and("l_linenumber"), any_bits=F.bit_or("l_linenumber")
    )


@query(
    "select event_id, user_id, coalesce(sum(user_id) over (order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as exscan,"
    " (sum(user_id) over (order by ts, event_id rows between unbounded preceding and current row))::bigint as scan, (sum(user_id) over ())::bigint as total from events"
)
def running_totals(spark, sf_dir):
    return C.running_total(load(spark, sf_dir, "events").select("event_id", "ts", "user_id"), TIME, "user_id").drop("ts")


@query("select event_id, event_type = 'purchase' as flag, coalesce(last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (order by ts, event_id rows between unbounded preceding and 1 preceding), event_id) as prev_flagged from events")
def last_flagged(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") == "purchase").alias("flag"))
    return C.last_flagged(rows, TIME, F.col("flag"), "event_id").drop("ts")


# -- checks as data

@query("select true as sorted, true as complete, ((count(*) + 7) // 8)::int as most from orders")
def verified_sort(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = S.balanced_sort(rows, PRICE, P8).persist()
    return spark.createDataFrame([(V.is_sorted(out, PRICE), V.nothing_lost(rows, out), max(V.loads(out, P8)))], "sorted boolean, complete boolean, most int")

