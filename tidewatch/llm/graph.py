"""Connected components of link tables, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import discard, staged


BROADCAST_EDGES = 200_000  # so many (16 bytes each) are sent to all tasks at most


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in `links` (a, b); the component is its smallest node.

    Each round hangs every node's neighbours below the smallest of them (first among larger
    neighbours, then among smaller ones), until each hangs directly below one that hangs below none: the square of the
    logarithm of the longest path bounds the rounds. Rounds cut lineage with a table in the shared folder. Only
    counts reach the driver. Self-links and nulls are left out; links may repeat.
    """
    edges = staged(_down(links).distinct())
    while True:
        few = edges.count() <= BROADCAST_EDGES
        if _are_stars(edges, few):
            break
        former, edges = edges, staged(_small_star(_large_star(edges, few), few))
        discard(former)
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def _are_stars(edges: DataFrame, few: bool) -> bool:
    """Whether every node hangs below one other at most, and none below a node that hangs below another."""
    above = edges.select(F.col("a").alias("node"), F.col("b").alias("top"))
    ends = edges.select("b") if few else edges.select("b").distinct()
    ends = edges.unionByName(ends.select(F.col("b").alias("a"), "b"))
    deeper = (F.col("a") == F.col("node")) & (F.col("b") != F.col("top"))
    return not ends.join(F.broadcast(above) if few else above, deeper, "left_semi").count()


def _down(links: DataFrame) -> DataFrame:
    """Every link from the larger node `a` to the smaller node `b`."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return _down(larger.join(F.broadcast(least) if few else least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(hung.unionByName(least.select("a", F.col("m").alias("b")))).distinct()
