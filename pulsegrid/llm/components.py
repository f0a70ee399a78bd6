"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import Scratch


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood instead."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node) of all nodes of the links (a, b), except the components' own smallest.

    Groups are reduced to their minimum before they move; each round is a written table, so nothing is computed twice.
    """
    state = links.select("a", "b").where("a <> b").distinct()
    held, before, number = None, None, 0
    while True:
        new = scratch.write(_small(_large(state)), f"{name}-{number}")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if held is not None:
            scratch.drop(held)
        state = held = new
        if after == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, number = after, number + 1
