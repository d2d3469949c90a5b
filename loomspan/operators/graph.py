"""Connected components over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.storage import discard, settle

MAX_ROUNDS = 60


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``: every node of ``edges`` with the smallest node it
    reaches. Nulls and loops are ignored; no edges give no rows.

    Alternating large-star and small-star rounds: joins and partial minimums
    only, so no node's neighbours are gathered in one row and Spark may split
    the join of a crowded node. Each round is written to the shared folder,
    and the one before it goes.
    """
    found = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = settle(found.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.sum(F.hash("b").cast("long"))).first()
    size, last = state(edges), None
    for _ in range(MAX_ROUNDS):
        if size == last or not size[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, settle(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        discard(before)
        last, size = size, state(edges)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
