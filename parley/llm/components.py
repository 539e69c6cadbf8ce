"""Connected components of a table of links, by alternating large and small stars.

Every round hangs the neighbours of each node on the smallest node around it: first the larger neighbours, then the smaller
ones. Both steps are an aggregate with map-side combine and a join on the node, so a node with very many links is a skewed
join key, which adaptive execution splits, and never one group in memory. A round is written to the shared folder before the
next, so lineage does not grow. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another; the root is the smallest node of its component, itself included.

    Links may be in either direction, repeated, or from a node to itself; null ends are left out.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = written(pairs.distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if seen == state or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = seen
        now = written(_star(_star(now, True), False), "links")
