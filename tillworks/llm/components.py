"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.session import settle


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of the node and its neighbours."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("_least"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.least("a", "_least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_least"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("_least")).select(
        F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.union(least)


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes with a link to another.

    Takes links (a, b) in either direction, repeated or not; links of a node with itself and with
    NULL are left out. A node with very many links is only met in an aggregate that combines
    before the shuffle and in a join that Spark splits. Each round is written to the scratch
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    a, b = links.columns[:2]
    now = settle(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(),
        "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = settle(_small_star(_large_star(now).distinct()).distinct(), "links")
