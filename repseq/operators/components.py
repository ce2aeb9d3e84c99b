"""Connected components by alternating large-star and small-star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repseq.session import cut_lineage, few, join_counted


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(both.where("v > u"), least, "u", "n", 2 * total, "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_counted(edges, least, "u", "n", total, "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges``: one row ``(node, component)`` per node that has an edge.

    ``component`` is the smallest node reachable. Every round rewires edges towards local minima, so the number of
    rounds grows with the logarithm of a component's diameter and no round holds more edges than the first. Rounds are
    cut with ``checkpoint()``; nodes with very many edges are joined by broadcast, so no task meets all edges of one;
    few edges are kept in few partitions. Self-loops and repeated edges are ignored; NULL ends drop the edge; no edges give no rows.
    """
    work = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a != b")
    loops = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u = v")
    work = cut_lineage(work.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, total = None, work.count()
    work = few(work, total)
    for _ in range(max_rounds):
        work = cut_lineage(few(_large_star(work, total).distinct(), total))
        work = cut_lineage(few(_small_star(work, total).distinct(), total))  # no step adds edges
        now = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    lone = loops.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots).union(lone).groupBy("node").agg(F.min("component").alias("component"))
