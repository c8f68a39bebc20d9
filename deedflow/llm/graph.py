"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, small


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it is connected with.

    Alternates large-star and small-star contraction: each round is two grouped minima (combined before the
    shuffle) and two joins on a node. Minima are written before they are joined, so that a hub with very many
    neighbours is split like any skewed join key; few minima are broadcast. Ends when nothing changes. Nulls are no nodes; an edge of a node
    with itself alone gives nothing.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    now = materialise(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        moved = both.join(small(least, least.count()), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialise(moved.distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        down = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        moved = large.join(small(down, down.count()), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, materialise(moved.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(old, least, large, down)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
