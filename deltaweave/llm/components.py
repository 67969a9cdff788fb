"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.storage import cut, release

#: Edges that a partition of a round's result should hold at least.
EDGES_A_TASK = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``a, b`` for each node ``a`` that is not the smallest of its component, ``b`` being it.

    ``edges`` has two columns of one orderable type; loops and doubles are allowed. Every
    minimum is aggregated before it is joined back, so no node's neighbours meet in one task
    on their own. Each round is cut to the shared checkpoint folder, in partitions that follow
    the number of edges, and lets go of the round before: a small graph leaves few small files.
    """
    x, y = edges.columns
    edges = cut(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct())
    state = _state(edges)
    spark, tasks = edges.sparkSession, 1 + state[0] // EDGES_A_TASK
    edges = edges.coalesce(tasks)
    for _ in range(most_rounds):
        if not state[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("x")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("x")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b")))
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().coalesce(tasks))
        del both, least, large, small
        release(spark)
        if (now := _state(edges)) == state:
            return edges
        state = now
    raise RuntimeError("components did not settle")
