"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.common import saved, scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b), where root is the smallest node of its component.

    Every round is two aggregations and two equi-joins over links and never holds a component together: links of a
    large component stay rows spread by node. Each round is a table in the shared folder, so a lost executor costs at
    most the running round. Loops and null ends are ignored; an empty table gives an empty table.
    """
    spark, folder = links.sparkSession, scratch(links.sparkSession)
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = saved(pairs, f"{folder}/0")
    seen, turn = _state(pairs), 0
    while seen[0]:
        turn += 1
        pairs = saved(_small_star(_large_star(pairs)), f"{folder}/{turn}")
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node among the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.where(F.col("b") > F.col("a")).join(low, "a")
    return up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m"))
    down = pairs.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
