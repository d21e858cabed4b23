"""Connected components by alternating large-star and small-star steps.

Each step is two shuffles on node ids with map-side minima; the edge list never
grows and stars halve in depth, so the number of rounds is logarithmic. Every
round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.plans.lineage import cut


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs(u, v): link each neighbour of u (and u) to the smallest of them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m0"))
    low = low.select("u", F.least("u", "m0").alias("m"))
    joined = pairs.join(low, "u")
    if keep_larger:  # large-star: neighbours above u
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    up = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return up.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node id reachable) for every node that has an edge to another node."""
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True).where("a != b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        e = cut(_star(down, False).where("a != b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
