"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of ``(u, v)`` edges with ``v < u`` on the way out. The neighbourhood
    minimum is an aggregate joined back, so no neighbourhood is held by a task."""
    both = edges.select(F.col("u"), F.col("v"))
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (longs); ``root`` is the smallest
    node reachable. Self edges are ignored; an empty table gives an empty result. The
    number of rounds grows with the logarithm of the longest path; running out of rounds
    raises instead of returning partial classes."""
    cur = cut(edges.where(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        nxt = cut(_star(_star(cur, True), False))
        new = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if tuple(new) == mark:
            roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        mark = tuple(new)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
