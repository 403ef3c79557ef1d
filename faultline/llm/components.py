"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum per node, combined in the tasks, and a join; nothing is collected. Each table is written before it is
used twice, so a node with very many links is an ordinary skewed join that adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checkpoint(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(u, v) long links, any order, repeats allowed -> (node, root) for every node but the roots; root is the least node."""
    edges = checkpoint(_small_star(checkpoint(links.select("u", "v").filter("u <> v"))))
    before = _state(edges)
    while before[0]:
        edges = checkpoint(_small_star(checkpoint(_large_star(edges))))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
