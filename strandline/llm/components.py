"""Connected components of an edge table, without any vertex's neighbours in one place.

Alternating star contraction: a large star ties a vertex's greater neighbours to its least one, a small star its lesser
ones; both are a grouped minimum (combined before the shuffle) and a join, which splits at hubs. About log2(n) rounds,
each written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.shared import shared_checkpoint


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _large(e: DataFrame) -> DataFrame:
    near = _both_ways(e)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every vertex of an edge with the least vertex of its component. Loops, repeats and nulls are harmless."""
    now = shared_checkpoint(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    while True:
        after = shared_checkpoint(_small(_large(now)))
        # a star forest is a fixed point: every vertex has one edge, to a vertex without one
        loose = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
        done = loose.where("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        now = after
        if done:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
