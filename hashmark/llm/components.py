"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashmark.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component_id`` (the smallest id reachable) of every id in ``links`` (``a``, ``b``: long).

    Each step hangs the neighbours of a node on its smallest neighbour, by a grouped minimum (combined map-side) and a
    join, so that a node with very many links is never gathered.  It ends when a step changes nothing, after about as many
    steps as the logarithm of the longest path.
    """
    edges = written(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum("b").alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or state["n"] == 0:
            break
        before = state
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return roots.unionByName(roots.select(F.col("component_id").alias("id"), "component_id").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or to the node)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
