"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no component is ever gathered in one task; the number of
steps grows with the logarithm of the longest path. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    # written first: then both sides of the join are shuffled, and Spark can split a node with many links
    least = scratch.write(least, "least")
    joined = both.filter("b > a").join(least, F.col("a") == F.col("n"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = scratch.write(down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "least")
    kept = down.join(least, F.col("a") == F.col("n"))
    # each neighbour points at the least one, and so does the node itself
    return kept.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct(), least


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: columns a, b of one orderable type. Returns (node, component) for each node that has a link to
    another; component is the least node of its component. Loops and repeated links are allowed.

    Steps go on until one changes nothing; each moves links towards lesser nodes, so they end."""
    current = scratch.write(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
        if state == before or state[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = state
        large, least = _large_star(current, scratch)
        large = scratch.write(large, "links")
        small, least2 = _small_star(large, scratch)
        found = scratch.write(small, "links")
        scratch.drop(current, least, large, least2)
        current = found
