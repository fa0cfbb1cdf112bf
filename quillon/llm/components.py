"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import saved

#: Links that one task holds: a table of fewer is one partition, and its rounds need no exchange.
TASK_LINKS = 1 << 17


def components(links: DataFrame, rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b: bigint); a component is named after its smallest node.

    Each round hangs the neighbours of a node on the smallest one, first the larger
    neighbours, then the smaller ones; the rounds needed grow with the logarithm of
    the longest path. The number of links never grows, so the tasks of a round
    follow from their first count. Tables are pre-aggregated and no node's links
    are collected.
    """
    pairs = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a != b")
    edges = saved(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(1, -(-edges.count() // task_links))
    mark = None
    for _ in range(rounds):
        edges = edges.coalesce(tasks)
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # a node hangs on its smallest neighbour, and so do its other smaller neighbours
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = saved(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = edges.coalesce(tasks)
    tops = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
