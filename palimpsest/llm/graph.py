"""Connected components by alternating star operations, in DataFrame steps that never gather a neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SHARES, Scratch


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v) with m, the least of u and all its v.

    A hub has at least one row in SHARES: there are no more hubs than that, so their numbers go to the plan and their
    least values to all tasks, and none of their rows is shuffled.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = least.where(F.col("n") >= max(2.0, total / SHARES)).select("u", "m").collect()
    if not hubs:
        return pairs.join(least.select("u", "m").hint("merge"), "u")
    table = pairs.sparkSession.createDataFrame([tuple(r) for r in hubs], "u long, m long")
    many = F.col("u").isin([r["u"] for r in hubs])
    others = pairs.where(~many).join(least.where(~many).select("u", "m").hint("merge"), "u")
    return pairs.where(many).join(F.broadcast(table), "u").unionByName(others)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("v"))
    moved = _with_least(down, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b); the label is the least node of its component.

    Nodes without an edge to another node are not returned. Each step is written, so the lineage stays short; the rounds
    end when the edges no longer change, which their number and the sum of their hashes show.
    """
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        large = scratch.keep(_large_star(now, state["n"]).distinct(), name)
        now = scratch.keep(_small_star(large, state["n"]).where(F.col("u") != F.col("v")).distinct(), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
