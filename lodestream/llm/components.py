"""Connected components by alternating large-star and small-star rounds (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(scratch: Scratch, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One star round over undirected edges (a, b).

    The minimum of each neighbourhood is a partial aggregate.  It is written before it is
    joined back, so both sides of the join have an exchange of their own and adaptive
    execution can split the neighbourhood of a hub.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-lows")
    out = both.join(lows, "u")
    if large:  # an edge comes out once for each time it went in
        return scratch.save(out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")), name)
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(lows.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return scratch.save(out.where("a <> b").distinct(), name)


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) are stars: every node has one edge to its root, or is a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint); root: the smallest node reachable.

    Rounds repeat until one star a component is left.  Each round reads and writes only tables in
    the shared folder, and the ones before it are dropped.
    """
    now, k = scratch.save(edges.where("a <> b").select("a", "b"), "cc-0"), 0
    while True:
        mid = _star(scratch, now, True, f"cc-{k}-large")
        new = _star(scratch, mid, False, f"cc-{k}-small")
        for name in (f"cc-{k}-large", f"cc-{k}-large-lows", f"cc-{k}-small-lows", f"cc-{k - 1}-small" if k else "cc-0"):
            scratch.drop(name)
        if _settled(new):
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, k = new, k + 1
