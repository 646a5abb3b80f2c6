"""Connected components of an edge table, without collecting an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its smallest node.

    Alternating large-star and small-star steps: every node hands its smallest neighbour to its larger ones, then
    all smaller ones to its smallest.  The number of rounds is about the logarithm of the longest path.  Smallest
    neighbours are pre-aggregated and written before they are joined back, so that the join has an exchange of its own
    on either side and adaptive execution can split a node with very many edges.
    """
    now = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        large = written(large, "large-star")
        release(least)
        least = written(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = written(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "small-star")
        release(large, least)
        state = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(now)
        now = small
        if state == last:
            break
        last = state
    # Now every edge leads from a node to its component's smallest.
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
