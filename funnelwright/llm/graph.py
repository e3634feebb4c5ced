"""Connected components of a graph given as pairs, for graphs of any size and any hub."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from funnelwright.session import cut_lineage


def _distinct(e: DataFrame) -> DataFrame:
    return e.where("a <> b").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _distinct(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return _distinct(down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))))


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``pairs`` (``a``, ``b``) that has a link.

    Alternating stars: each round is two groupings and two joins on the node, whose right side has one row per node,
    so a hub is split by adaptive execution. Rounds end when a round changes nothing. Null ends are left out.
    """
    e = cut_lineage(_distinct(pairs.select("a", "b").where("a is not null and b is not null")))
    mark = None
    while True:
        e = cut_lineage(_small_star(_large_star(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            # The smallest node of a component stands on the right only.
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
