"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component as ``root``.

    ``edges`` has two long columns ``a`` and ``b``; nodes without an edge do not appear.
    Large-star and small-star steps alternate until nothing moves: each hangs a node's
    neighbours below the least one, so the number of rounds grows with the logarithm of
    the longest chain and no row holds a neighbour list.  Every round is a checkpoint in
    the shared folder.  Null ends, loops and repeated edges are allowed and have no effect.
    """
    now = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        large = _star(now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = cut_lineage(_star(large, larger=False))
        # the sum of an order-free digest of the edges tells whether a round moved anything
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = small
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges a -> b.

    larger: neighbours of a that are greater than a move to the least neighbour (or a itself).
    Otherwise every edge points down (a > b) and a with all its neighbours moves to the least one.
    """
    least = directed.groupBy("a").agg(F.min("b").alias("m"))
    if larger:
        m = least.select("a", F.least("a", "m").alias("m"))
        out = directed.filter("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = directed.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()
