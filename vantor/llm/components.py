"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import SMALL, cut

#: So many edges are written as one partition, of some MB.
EDGES_PER_PART = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: two columns of longs. Self-loops, repeated and reversed edges, and nulls do no harm. Each step keeps one row
    per edge, aggregates before it shuffles, and joins a unique table, so a hub's rows can be split over tasks. The
    joined table is sent to all tasks while the edges are few, and shuffled beyond.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        small_enough = (lambda df: F.broadcast(df)) if mark[0] <= SMALL else (lambda df: df)  # at most 2 * mark[0] rows
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(small_enough(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_enough(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(now.coalesce(1) if mark[0] <= EDGES_PER_PART else now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
