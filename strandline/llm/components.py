"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Latest


def _stars(links: DataFrame, all_neighbours: bool) -> DataFrame:
    """Links each node's neighbours to the least of them and itself: the larger ones (large star), or the smaller ones and the node (small star).

    links has each link once, with ``a`` > ``b``; so has the result, with ``changed`` where a link is not one of those that went in. The
    least neighbour comes from an aggregation that is joined back, so that a node with very many links is combined before the shuffle
    and split after it.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if all_neighbours:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if all_neighbours:
        new = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"), F.expr("m <> u").alias("changed"))
    else:
        new = joined.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"), F.expr("v <> m").alias("changed"))
    return new.filter("a > b").groupBy("a", "b").agg(F.max("changed").alias("changed"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node that can be reached) of every node that has a link to another one.

    Links are undirected; repeated links and links of a node to itself do nothing; links with a null end are left out; no links
    give no rows. The links, never the nodes, are stored between rounds, and each round's table replaces the one before. The end is where
    a round changes no link; the rounds grow with the logarithm of the nodes.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    kept, between = Latest("links"), Latest("stars")
    now = kept.put(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    moving = not now.isEmpty()
    while moving:
        large = between.put(_stars(now, True))
        now = kept.put(_stars(large, False))
        moving = not large.filter("changed").select("a").unionByName(now.filter("changed").select("a")).isEmpty()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
