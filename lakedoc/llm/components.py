"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``a, b`` edges of longs.

    Alternates large-star and small-star steps, each a minimum by node and a join, so no
    node's neighbours are gathered anywhere; stars stop changing after a number of rounds that
    grows with the logarithm of the longest path.
    """
    graph = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are spread anew, so that the joins shuffle both sides by node and Spark may split a node of very many neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v")
        graph = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    least = graph.groupBy("u").agg(F.min("v").alias("component"))
    return least.select(F.col("u").alias("node"), "component").unionByName(graph.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component")))
