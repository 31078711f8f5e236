"""Connected components by alternating large-star and small-star steps, each a few joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm.common import cut


def _lowest(sides: DataFrame) -> DataFrame:
    """sides: u, v for each node u and its neighbours; the least of u and its neighbours for each u."""
    return sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: longs u, v. Returns node, root for every node of an edge between different nodes; root is the least node.

    A node's neighbours are never gathered in one row: minima are pre-aggregated, and joins by a busy node can be split.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:  # each round lowers some node's neighbour, so it ends; the number of rounds grows with the logarithm of the nodes
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        # large star: larger neighbours go to the least
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the least
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(small, "u")
        nxt = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = cut(nxt)
        # a forest of stars is reached when no root is below another: no node is both a leaf and a root
        open_ = nxt.select("u").join(nxt.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        split = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        now = nxt
        if not open_ and not split:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
