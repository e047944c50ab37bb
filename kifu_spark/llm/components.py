"""Connected components of a large graph by alternating large and small stars, one checkpoint a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kifu_spark.llm.skew import join_counted
from kifu_spark.session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each larger neighbour of u is linked to the smallest of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("copies"))
    linked = join_counted(near.filter("v > u"), least, "u", 2 * rows)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """u and each smaller neighbour of u are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies"))
    return (
        join_counted(down, least, "u", rows).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) from edges (u, v); nodes without edges are not listed.

    Each round is two joins on the node after a pre-aggregated minimum; nodes with many links, of which there are few,
    have theirs broadcast. The rounds grow with the logarithm of the longest path. The driver only sees a count and a
    checksum a round.
    """
    now = cut(edges.filter("u != v").select("u", "v").distinct())
    seen, rows = None, now.count()
    for _ in range(most_rounds if rows else 0):
        large = cut(_large_star(now, rows).distinct())
        now = cut(_small_star(large, large.count()).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, rows = state, state[0]
    else:
        if rows:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
