"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import written


def _mark(edges: DataFrame) -> tuple:
    """What changes when the set of edges does."""
    row = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the component's smallest node.

    Each round joins every node's neighbours to the smallest one: first those above the node (large
    star), then those below it (small star). Sums by node are combined before the exchange, so a node
    with many links is no hot key there. Every round's edges are a written table; the driver sees two
    numbers per round.
    """
    edges = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(below.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = written(small, "components")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
