"""Queries whose result is a property: of samples, cuts and loads, and of plans on the driver.

No SQL draws the same rows or the same pivots, but SQL can say what must hold of them.
Planner queries return what the planner said, for numbers that come from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankweave.operators import exchange as X
from rankweave.operators import pivots as V
from rankweave.operators import rank as R
from rankweave.operators import sampling as A
from rankweave.operators import scan as C
from rankweave.operators import sorters as S
from rankweave.operators.metrics import SortMetrics
from rankweave.plans import assignment, levels, packing
from rankweave.registry import query
from rankweave.sources import load
from rankweave.spec import SortSpec

PRICE = SortSpec.by("o_totalprice", ties=["o_orderkey"])
PRIORITY = SortSpec.by("o_orderpriority", ties=["o_orderkey"])
P8 = 8


def _orders(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", *more)


# -- pivots and medians


@query("select count(*) as n, true as close from orders")
def median_sketch(spark, sf_dir):
    """The sketch's median has a rank within a thousandth (one at least) of half the rows."""
    orders = _orders(spark, sf_dir)
    (m,) = R.median(orders, "o_totalprice", exact=False).first()
    seen = orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") < m).alias("low"), F.count_if(F.col("o_totalprice") <= m).alias("high"))
    slack = F.greatest(F.lit(2.0), F.col("n") / 1000)
    return seen.select("n", ((F.col("low") <= F.col("n") / 2 + slack) & (F.col("high") >= F.col("n") / 2 - slack)).alias("close"))


@query(
    "with r as (select n_regionkey * 100 + n_nationkey as v, row_number() over (order by n_name) - 1 as i from nation), one as (select i // 3 as i, median(v) as v from r where i < 9 group by 1)"
    " select median(v)::bigint as median from one"
)
def ternary_median(spark, sf_dir):
    """A tree of medians of three over the first nine of the nations in order of name."""
    rows = R.global_rank(load(spark, sf_dir, "nation").select("n_name", (F.col("n_regionkey") * 100 + F.col("n_nationkey")).cast("long").alias("v")), SortSpec.by("n_name"))
    return V.ternary_median(rows, "rank", "v")


@query("select count(*) as n, true as central from orders")
def sample_pivot(spark, sf_dir):
    """The median of a sample leaves a third of the rows on either side."""
    orders = _orders(spark, sf_dir, "o_orderpriority")
    pivot = V.sample_pivot(orders, PRIORITY, P8, seed=4).first()
    below = PRIORITY.before(tuple(pivot))
    seen = orders.agg(F.count("*").alias("n"), F.count_if(below).alias("low"))
    return seen.select("n", (F.col("low").between(F.col("n") / 3, 2 * F.col("n") / 3)).alias("central"))


# -- samples


@query("select 500::bigint as drawn, 0::bigint as strangers, count(*) as n from orders")
def uniform_sample(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    drawn = A.uniform(orders, 500, seed=5)
    strangers = drawn.join(orders, "o_orderkey", "left_anti")
    return orders.agg(F.count("*").alias("n")).select(F.lit(drawn.count()).alias("drawn"), F.lit(strangers.count()).alias("strangers"), "n")


@query("select 300::bigint as drawn, count(*) as n, true as low from orders")
def uniform_sample_within(spark, sf_dir):
    """Places drawn below the number of rows that every partition has: none is dropped."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey").repartition(4, "o_orderkey")
    least = min(C.partition_counts(orders).values())
    drawn = A.uniform(orders, 300, seed=6, within=least)
    n = drawn.count()
    return orders.agg(F.count("*").alias("n")).select(F.lit(n).alias("drawn"), "n", F.lit(drawn.distinct().count() <= 4 * least).alias("low"))


@query("select count(*) as n, count(*) as gids from orders")
def sample_with_tie(spark, sf_dir):
    """Rows told apart by partition and place; sampled rows keep what tells them apart."""
    rows = A.with_tie(_orders(spark, sf_dir).repartition(3, "o_orderkey"))
    drawn = A.uniform(rows, 200, seed=7)
    kinds = drawn.select("o_orderkey", "gid").distinct()
    one = kinds.count() == kinds.select("gid").distinct().count()
    return rows.agg(F.count("*").alias("n"), (F.count_distinct("gid") if one else F.lit(-1)).alias("gids"))


@query("select count(*) filter (where o_totalprice between 1000.0 and 60000.0) as inside, 0::bigint as outside, true as close from orders")
def bernoulli_sample(spark, sf_dir):
    inside = F.col("o_totalprice").between(1000.0, 60000.0)
    orders = _orders(spark, sf_dir)
    drawn = A.bernoulli(orders, 0.1, seed=5, windows=inside).agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside")).first()
    all_ = orders.agg(F.count_if(inside).alias("inside"))
    close = F.abs(F.lit(drawn.n) - 0.1 * F.col("inside")) <= 6 * F.sqrt(0.09 * F.col("inside"))
    return all_.select("inside", F.lit(drawn.outside).alias("outside"), close.alias("close"))


@query("select o_orderstatus as part, count(*) as cnt, 1000::bigint as total, true as stacked from orders group by 1")
def multinomial_quota(spark, sf_dir):
    """Quotas that add up to the total, stacked up by their exclusive prefix."""
    quotas = A.quotas(load(spark, sf_dir, "orders"), 1000, seed=5, part=F.col("o_orderstatus"))
    rows = sorted(quotas.collect(), key=lambda r: r.part)
    total = sum(r.quota for r in rows)
    stacked = all(r.exscan == sum(q.quota for q in rows[:k]) and 0 <= r.quota for k, r in enumerate(rows))
    return quotas.select("part", "cnt", F.lit(total).cast("long").alias("total"), F.lit(stacked).alias("stacked"))


@query("with o as (select count(*) as n from orders) select g.i::bigint as slot, 1::bigint as cnt, (g.i + 1) * n // 10 - g.i * n // 10 as size from o, (select unnest(range(10)) as i) g")
def one_of_each_range(spark, sf_dir):
    ranked = R.ranked(_orders(spark, sf_dir), PRICE)
    edges = [k * ranked.n // 10 for k in range(11)]
    drawn = A.one_of_each_range(ranked, list(zip(edges, edges[1:], strict=False)), seed=8)
    size = F.element_at(F.array(*[F.lit(b - a).cast("long") for a, b in zip(edges, edges[1:], strict=False)]), F.col("slot").cast("int") + 1)
    slot = sum((F.col("rank") >= e).cast("long") for e in edges[1:-1])
    return drawn.withColumn("slot", slot).groupBy("slot").agg(F.count("*").alias("cnt")).select("slot", "cnt", size.alias("size"))


# -- loads of the sorters


_LOADS = "with n as (select 'orders by price' as kind, count(*) as n from orders union all select 'orders by priority', count(*) from orders union all select 'lines by flag', count(*) from lineitem) select kind, n, 8 as slots, true as bounded, true as placed from n"


def _loads(spark, sf_dir, sort) -> DataFrame:
    """Of unique, tied and heavily tied keys: rows, slots, and whether the largest load is at most 1.1 times the even one."""
    orders = _orders(spark, sf_dir, "o_orderpriority")
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    flag = SortSpec.by("l_returnflag", ties=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])
    out = []
    for kind, df, spec in (("orders by price", orders, PRICE), ("orders by priority", orders, PRIORITY), ("lines by flag", lines, flag)):
        rows = sort(df, spec).withColumn("landed", F.spark_partition_id()).groupBy("landed").agg(F.count("*").alias("n"), F.bool_and(F.col("pid") == F.col("landed")).alias("placed"))
        n = F.sum("n")
        out.append(rows.agg(F.lit(kind).alias("kind"), n.alias("n"), F.lit(P8).alias("slots"), (F.max("n") <= F.ceil(1.1 * F.ceil(n / P8)) + 1).alias("bounded"), F.bool_and("placed").alias("placed")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_LOADS)
def ams_loads(spark, sf_dir):
    return _loads(spark, sf_dir, lambda df, spec: S.over_partition_sort(df, spec, P8))


@query(_LOADS)
def ams_loads_of_equal_keys(spark, sf_dir):
    """The same without ties: buckets of equal keys are cut at exact places."""
    return _loads(spark, sf_dir, lambda df, spec: S.over_partition_sort(df, SortSpec(spec.keys), P8))


@query(_LOADS)
def hss_loads(spark, sf_dir):
    return _loads(spark, sf_dir, lambda df, spec: S.histogram_sort(df, spec, P8))


@query(_LOADS)
def rlm_loads(spark, sf_dir):
    return _loads(spark, sf_dir, lambda df, spec: S.select_sort(df, spec, P8))


@query("select samples, 7 as cuts, count(*) as n, true as rounds, true as within from orders, (select unnest([1, 5])::int as samples) group by samples")
def cut_rounds(spark, sf_dir):
    """Cuts come from histogram rounds, few of them, and lie within their slack."""
    orders, rows = _orders(spark, sf_dir), []
    for samples in (1, 5):
        done = R.Search()
        cuts = R.boundaries(orders, PRICE, P8, eps=0.1, samples=samples, done=done)
        n = orders.count()
        within = all(abs(c.rank - (k + 1) * n // P8) <= 0.1 * n / P8 / 2 + 1 for k, c in enumerate(cuts))
        few = 1 <= done.rounds <= 60 and (samples > 1 or done.pivots <= 7 * done.rounds)
        rows.append((samples, len(cuts), n, few, within))
    return spark.createDataFrame(rows, "samples int, cuts int, n long, rounds boolean, within boolean")


@query("select sorter, phase, true as timed from (values ('ams', 'sampling'), ('ams', 'partition'), ('ams', 'packing'), ('ams', 'exchange'), ('hss', 'splitters'), ('hss', 'exchange'), ('rquick', 'exchange'), ('janus', 'partition'), ('janus', 'exchange')) t(sorter, phase)")
def sort_phases(spark, sf_dir):
    """The phases that each sorter times."""
    rows = []
    for name, sort in (("ams", S.over_partition_sort), ("hss", S.histogram_sort), ("rquick", S.quick_sort), ("janus", S.balanced_sort)):
        told = SortMetrics()
        sort(_orders(spark, sf_dir), PRICE, P8, metrics=told)
        rows += [(name, phase, seconds >= 0) for phase, seconds in told.seconds.items()]
    return spark.createDataFrame(rows, "sorter string, phase string, timed boolean")


# -- plans


@query("select l::int as level, least(count(*), 3 ** l)::bigint as groups, count(*) as slots, 1 as spread from nation, (select unnest([1, 2, 3]) as l) group by l")
def level_plan(spark, sf_dir):
    """Groups of each level for as many slots as there are nations, three a level: sizes differ by one at most."""
    p = load(spark, sf_dir, "nation").count()
    plan = levels.level_plan(p, 3)
    rows = [(k + 1, len(sizes), sum(sizes), max(1, max(sizes) - min(sizes))) for k, sizes in enumerate(plan)]
    return spark.createDataFrame(rows, "level int, groups long, slots long, spread int")


@query("select count(*) as n, 5::bigint as groups, (2 ** ceil(ceil(log2(count(*))) / 2))::bigint as of_two_levels from nation")
def level_groups(spark, sf_dir):
    n = load(spark, sf_dir, "nation").count()
    return spark.createDataFrame([(n, len(levels.subgroups(n, 5)), levels.groups_for_levels(n, 2))], "n long, groups long, of_two_levels long")


@query("select l::int as level, round(greatest(1.1 ** 0.5 - 1, 1.1 ** ((l + 1) / 2.0) - 1 - 0.01), 9) as imbalance from (select unnest([0, 1]) as l)")
def level_imbalance(spark, sf_dir):
    """What two levels may add if the levels before have used one percent."""
    rows = [(k, round(levels.level_imbalance(0.1, 2, k, 101, 100), 9)) for k in (0, 1)]
    return spark.createDataFrame(rows, "level int, imbalance double")


@query(
    "select p, 20 as b, 20 * p - 1 as splitters, ceil(13 * greatest(1, ceil(log2(greatest(p, 2)))) / 20)::bigint * p * 20 as samples, c + (c % 2 = 0)::int as pivot, d + (d % 2 = 0)::int as pivot_added"
    " from (select p, n, greatest(floor(16 * log2(p)), floor(n / p / 50), 64)::bigint as c, greatest(floor(16 * log2(p)) + floor(n / p / 50), 64)::bigint as d"
    " from (select unnest([1, 3, 8, 25])::bigint as p), (select count(*) as n from orders))"
)
def sample_sizes(spark, sf_dir):
    """Over-partitioning, splitters and samples at eps 0.1, and samples for one pivot."""
    n = load(spark, sf_dir, "orders").count()
    rows = [(p, *levels.splitter_sizes(p, p, 0.1), levels.pivot_samples(n, p), levels.pivot_samples(n, p, added=True)) for p in (1, 3, 8, 25)]
    return spark.createDataFrame(rows, "p long, b int, splitters long, samples long, pivot long, pivot_added long")


@query("select count(*) as parts, 1000::bigint as total, true as fair from nation")
def equal_quota(spark, sf_dir):
    p = load(spark, sf_dir, "nation").count()
    quota = levels.equal_quota(p, 1000, 3)
    fair = all(abs(q - 1000 / p) <= 6 * (1000 / p) ** 0.5 for q in quota)
    return spark.createDataFrame([(len(quota), sum(quota), fair)], "parts long, total long, fair boolean")


@query(
    "with b as (select o_orderpriority as k, count(*) as n from orders group by 1), c as (select row_number() over (order by k) as i, n, sum(n) over (order by k) as upto from b),"
    " best as (select min(greatest(x.upto, y.upto - x.upto, t.total - y.upto)) as whole from c x, c y, (select sum(n) as total from b) t where x.i < y.i),"
    " e as (select (sum(n) + 2) // 3 as even from b) select whole::bigint as whole, even::bigint as divisible, whole - 1 < whole as tight from best, e"
)
def packing_capacity(spark, sf_dir):
    """Least capacity for three slots of the priorities' buckets: kept whole, and divisible."""
    counts = [r.n for r in load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority").collect()]
    held = [packing.least_capacity([packing.Bucket(n, divisible) for n in counts], 3) for divisible in (False, True)]
    tight = not packing.fits([packing.Bucket(n) for n in counts], 3, held[0] - 1)
    return spark.createDataFrame([(*held, tight)], "whole long, divisible long, tight boolean")


@query(
    "with s as (select o_orderkey % 4 as part, o_orderpriority as b, count(*) as n from orders group by 1, 2), p as (select *, sum(n) over (order by b, part) - n as a, sum(n) over () as total from s),"
    " g as (select unnest(range(3)) as slot), e as (select *, slot * total // 3 as low, (slot + 1) * total // 3 as high from p, g)"
    " select part::int as part, b as bucket, slot::int as slot, (least(a + n, high) - greatest(a, low))::bigint as n from e where least(a + n, high) > greatest(a, low)"
)
def packing_splits(spark, sf_dir):
    """How many rows of each input part and bucket go to each of three even slots."""
    rows = load(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4).cast("int").alias("part"), F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("n")).collect()
    names, size = sorted({r.bucket for r in rows}), {(r.part, r.bucket): r.n for r in rows}
    total = sum(size.values())
    splits = packing.splits_of([[size.get((p, b), 0) for b in names] for p in range(4)], [total // 3, 2 * total // 3])
    out = [(p, b, s, n) for p in range(4) for k, b in enumerate(names) for s, n in enumerate(splits[p][k]) if n]
    return spark.createDataFrame(out, "part int, bucket string, slot int, n long")


_STRIPES = (
    "with x as (select n_nationkey as x, sum(n_regionkey + 1) over (order by n_nationkey) as b, n_regionkey + 1 as s from nation),"
    " y as (select r_regionkey as y, sum(r_regionkey * 7 + 5) over (order by r_regionkey) as b, r_regionkey * 7 + 5 as s from region)"
)


@query(_STRIPES + " select x::int as x, y::int as y, (least(x.b, y.b) - greatest(x.b - x.s, y.b - y.s))::bigint as size from x join y on x.b - x.s < y.b and y.b - y.s < x.b")
def stripes(spark, sf_dir):
    """Overlaps of two divisions of one line, planned on the driver."""
    x = [r.s for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").select((F.col("n_regionkey") + 1).alias("s")).collect()]
    y = [r.s for r in load(spark, sf_dir, "region").orderBy("r_regionkey").select((F.col("r_regionkey") * 7 + 5).alias("s")).collect()]
    return spark.createDataFrame(packing.overlaps(x, y), "x int, y int, size long")


@query("select n_nationkey::int as message, (n_regionkey + 1)::bigint as size, true as whole_if_small, true as fits, true as few from nation")
def message_assignment(spark, sf_dir):
    """Messages to five receivers: small ones whole, all within capacity, few for each receiver."""
    sizes = [r.s for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").select((F.col("n_regionkey") + 1).cast("long").alias("s")).collect()]
    capacity = -(-sum(sizes) // 5) + 2
    parts = assignment.assign(sizes, [capacity] * 5)
    load_of = [sum(n for _, to, n in parts if to == r) for r in range(5)]
    few = max(sum(to == r for _, to, _ in parts) for r in range(5)) <= assignment.most_messages(len(sizes), 5)
    small = assignment.small_limit(len(sizes), [capacity] * 5)
    rows = []
    for k, size in enumerate(sizes):
        own = [n for m, _, n in parts if m == k]
        rows.append((k, sum(own), len(own) == 1 or size > small, max(load_of) <= capacity, few))
    return spark.createDataFrame(rows, "message int, size long, whole_if_small boolean, fits boolean, few boolean")


@query("select count(*) as n, ceil(count(*) ** (1 / 3.0) - 1e-9)::bigint as cube_root, floor(sqrt(count(*)))::bigint as root, floor(log2(count(*)) / log2(3) + 1e-12)::bigint as log3 from orders")
def whole_roots(spark, sf_dir):
    n = load(spark, sf_dir, "orders").count()
    import math

    return spark.createDataFrame([(n, levels.ceil_root(n, 3), math.isqrt(n), levels.floor_log(n, 3))], "n long, cube_root long, root long, log3 long")


# -- collectives


@query("select string_agg(n_name, '|' order by n_regionkey, n_name) as folded from nation")
def ordered_fold(spark, sf_dir):
    """Values combined in order by a function that does not commute."""
    rows = load(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    return C.fold_in_order(rows, SortSpec.by("n_regionkey", ties=["n_name"]), "n_name", lambda a, b: F.concat(a, F.lit("|"), b), fan=4)


@query("select n_name, row_number() over (order by n_name desc) - 1 as place from nation")
def ordered_gather(spark, sf_dir):
    """A small input in order on the driver."""
    from rankweave.operators.merge import merged_everywhere

    rows = merged_everywhere(load(spark, sf_dir, "nation").select("n_name"), SortSpec.by("n_name desc"))
    return spark.createDataFrame([(r[0], k) for k, r in enumerate(rows)], "n_name string, place long")


@query("select count(*) as n, 4 as parts from orders")
def folded_partitions(spark, sf_dir):
    """Rows moved to a power of two of partitions without a shuffle."""
    out = X.folded(_orders(spark, sf_dir).repartition(7, "o_orderkey"), 7).withColumn("p", F.spark_partition_id())
    return out.agg(F.count("*").alias("n"), F.count_distinct("p").cast("int").alias("parts"))


@query("select o_orderkey from orders where o_totalprice between (select quantile_disc(o_totalprice, 0.25) from orders) and (select quantile_disc(o_totalprice, 0.75) from orders)")
def middle_window(spark, sf_dir):
    """Rows between two cuts that were found by selection."""
    orders = _orders(spark, sf_dir)
    low, high = R.multi_select(orders, PRICE, lambda n: ([-(-n // 4) - 1, -(-3 * n // 4) - 1], 0))
    return orders.filter(F.col("o_totalprice").between(low.at[0], high.at[0])).select("o_orderkey")
