"""Distributed connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import discard, join_hot, staged


def _min_neighbour(edges: DataFrame, total: int) -> DataFrame:
    """edges(u, v) with the smallest v of each u beside it, and its number of edges. Hot u's edges aren't shuffled."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(edges, least, ["u"], total)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable.

    Each round is written to the shared folder, and the one before it removed. Rounds grow with the logarithm of the
    longest path; stars, as groups of copies give, need two. An empty table of links has no components.
    """
    edges = links.where((F.col(a).isNotNull()) & (F.col(b).isNotNull()) & (F.col(a) != F.col(b)))
    edges = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())

    before = mark(edges)
    while before[0]:
        both = _min_neighbour(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * before[0])
        large = staged(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "links")
        down = _min_neighbour(large, before[0])
        moved = down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        done, edges = edges, staged(moved.select("e.u", "e.v").where("u != v").distinct(), "links")
        discard(done, large)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
