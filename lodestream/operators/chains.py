"""Chains of records whose places follow from each other's sizes, found by many tasks at once.

A frame or page says where the next one begins, so a stream can only be walked from its start; but from any place
that looks like a record a walk is possible, and walks from false starts are left out in the end.  A file is cut into pieces;
each task walks its piece from every place near the piece's start at which a record could begin, which gives links from
entries to exits with the number of records between; ``ranked`` follows the links from the start of the file by pointer
doubling; and the pieces are walked once more from the entries that were reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(links: DataFrame, source: str, entry: str, exit_: str, count: str, start: int = 0) -> DataFrame:
    """(source, entry, rank): the entries reached from ``start``, and how many records lie before them.

    ``links`` has one exit and count an entry.  Round k joins the entries reached so far, 2 ** k at most of a source, with
    links of 2 ** k steps, and doubles these; so a chain of n links takes log2(n) rounds of equality joins.  Each round is
    a reliable checkpoint.  An exit that is no entry ends its chain and is among the results.
    """
    jumps = links.select(F.col(source).alias("s"), F.col(entry).alias("a"), F.col(exit_).alias("b"), F.col(count).cast("bigint").alias("n"))
    jumps = jumps.where("b > a").checkpoint()
    reached = jumps.select("s").distinct().select("s", F.lit(start).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("rank")).checkpoint()
    while True:
        more = reached.join(jumps, ["s", "a"]).select("s", F.col("b").alias("a"), (F.col("rank") + F.col("n")).alias("rank"))
        grown = reached.unionByName(more).distinct().checkpoint()
        if grown.count() == reached.count():
            return grown.select(F.col("s").alias(source), F.col("a").alias(entry), "rank")
        reached = grown
        next_ = jumps.select("s", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
        jumps = jumps.join(next_, ["s", "b"]).select("s", "a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n")).checkpoint()
