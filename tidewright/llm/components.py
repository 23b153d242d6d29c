"""Connected components of an edge table by alternating star contraction (large-star, small-star).

Every round is two joins on the edges alone; a hub is met by a join, which Spark can split, and not by a
window or a collected group. Rounds are cut by tables in the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stage, unstage


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a > b): link neighbours of each node to the least of them."""
    if large:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = e
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(a, b) links -> (node, root), root being the least node reachable; nodes without links are not listed.

    Self links and nulls are dropped, repeated links count once, an empty table gives an empty table.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b")
    e, path = stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        big, big_path = stage(_star(e, True), label)
        small, small_path = stage(_star(big, False), label)
        after = mark(small)
        for p in (path, big_path):
            unstage(spark, p)
        e, path = small, small_path
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
