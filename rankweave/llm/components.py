"""Connected components of a graph given as links, by alternating star contraction.

Large-star hangs every greater neighbour of a node on the node's least neighbour,
small-star the node and its lesser neighbours; both keep connectivity, and repeated
they turn every component into one star around its least node.  Each round is
written to the shared folder, so no plan grows and lost executors cost one round.
A node with very many neighbours is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankweave.llm.skew import join_spread, sizes
from rankweave.llm.storage import written


def _large_star(links: DataFrame, n: int, most: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    table = least.select("a", F.least("a", "m").alias("m"))
    greater = both.filter(F.col("b") > F.col("a"))
    return join_spread(greater, table, "a", least, n, most, "b", merge=True).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, n: int, most: int) -> DataFrame:
    # links point from the greater node a to the lesser node b
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_spread(links, least.drop("n"), "a", least, n, most, "b", merge=True)
    out = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


#: Bytes of two names, about.
ROW_BYTES = 64


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, comp (least node of its component) for every node of the links (a, b), of which
    there are at most `rows`, if that is known."""
    stars = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(stars, "links", rows and rows * ROW_BYTES)
    state = None
    while True:
        # a node's links to lesser nodes never become more by a large star, so `most` holds for both
        n, most = sizes(stars.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
        # n is twice the links; a round makes one of each, and one for each node that has any, at most
        stars = written(_small_star(_large_star(stars, n, most), n, most), "stars", n * ROW_BYTES)
        now = stars.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state or not now.n:
            break
        state = (now.n, now.h)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def merged(comps: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """The components that `comps` and more links between its nodes, or nodes of their own,
    give; `rows`: the links are at most so many, if that is known."""
    names = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")).hint("merge")
    joined = links.join(names("a"), "a", "left").join(names("b"), "b", "left")
    joined = joined.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).distinct()
    top = written(components(joined, rows), "merged", rows and 2 * rows * ROW_BYTES).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = comps.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = top.join(comps.select(F.col("node").alias("comp")).hint("merge"), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    return old.unionByName(new)
