"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b).

    Each round links every neighbour to the smallest node in reach (larger neighbours first, then smaller ones), until
    the edges are stars.  Minima are partial aggregates and the join back is a plain equi-join, so a node with very
    many neighbours is no single task's work.  Rounds are cut by tables in the shared folder; the driver sees two
    numbers a round.  Nodes are of any type that has an order.
    """
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionAll(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every edge now points from the larger node to the smaller; a node's smaller neighbours meet at their least.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        last, now = now, staged(small, "edges")
        release(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
