"""Connected components by alternating stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortkit.llm.store import discard, settle


def _print(edges: DataFrame) -> tuple:
    """Count and order-free sums: equal when two edge sets are."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                    F.sum(F.hash("b", "a").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is its component's smallest node.

    ``edges`` has two columns of one orderable type, in any direction; loops, repeated
    edges and edges with a null end are ignored.  No edges: an empty table.

    Each round hangs larger neighbours on the smallest one seen (large star), then smaller
    ones (small star); rounds grow with the logarithm of the longest path.  Minima are
    partial aggregates joined back, so that a hub's edges can be split over tasks.
    """
    u, v = edges.columns
    kept = settle(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
                      .filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("a") != F.col("b")))
                      .distinct())
    before = _print(kept)
    while before[0]:
        ends = (kept.select(F.col("a").alias("x"), F.col("b").alias("y"))
                .unionByName(kept.select(F.col("b").alias("x"), F.col("a").alias("y"))))
        least = ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = (ends.filter("y > x").join(least, "x")
                 .select(F.col("y").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        last = kept
        kept = settle(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                          .filter("a != b")
                          .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
        after = _print(kept)
        if after == before:
            break
        before = after
    return (kept.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
