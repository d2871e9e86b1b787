"""Connected groups of a graph given as edges, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.runtime import staged


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): every node with an edge, and the smallest node of its group.

    Alternates large stars (link larger neighbours to the smallest) and small stars (link smaller
    neighbours to the smallest) until nothing changes; rounds grow with the logarithm of the nodes. Minima
    are taken before the shuffle and the joins can be split, so a node with very many edges is no
    bottleneck. Each round is written to the shared folder: a lost executor costs one round at most.
    Null and self edges are ignored.
    """
    now = staged(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before, after = None, _fingerprint(now)
    while before != after:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(lowest, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = staged(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, after = after, _fingerprint(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
