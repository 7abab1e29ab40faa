"""Connected components of a graph given as pairs of numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge to another one.

    A large star links a node's greater neighbours to its smallest neighbour, a small star its smaller ones; the number of rounds
    grows with the logarithm of the size. Minima are aggregated before they are joined, so a node with very many neighbours is
    one row on one side of a join whose other side can be split. Every round is written to the shared folder.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    pairs, before = cut(pairs), None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == before or not mark[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        # Large star: every node tells its greater neighbours its smallest neighbour (or itself).
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: every node tells its smaller neighbours, and itself, the smallest of them.
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
