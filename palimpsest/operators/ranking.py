"""Ranked lists: total orders, top-k, fusion and reranking. A list has a row for each candidate, with query_id, evidence_id, rank and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import Retrieval
from palimpsest.functions.text import tie_key
from palimpsest.operators.pit import CLASSES

#: Scores closer than this are ties, which summing in another order must not break.
DECIMALS = 9


def order_by_score(score: str = "score", seed: int = Retrieval.tie_seed, query: str = "query_id", id_: str = "evidence_id") -> list[Column]:
    return [F.round(score, DECIMALS).desc(), tie_key(seed, F.col(query), F.col(id_)).asc()]


def top_k(scored: DataFrame, k: int, order: list[Column], query: str = "query_id") -> DataFrame:
    """Exact top k of each query with its rank; ties at the boundary are all considered, then broken."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def rerank(pool: DataFrame, order: list[Column], method: str, query: str | list[str] = "query_id") -> DataFrame:
    """The same candidates in a new order; the old rank is kept as prior_rank."""
    base = pool.drop("prior_rank", "method").withColumnRenamed("rank", "prior_rank")
    return base.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).withColumn("method", F.lit(method))


def minmax(column: str, query: str | list[str] = "query_id") -> Column:
    """Scaled to 0..1 within a query; all 0 where the span is nothing."""
    w = Window.partitionBy(query)
    low, span = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return F.when(span < 1e-12, F.lit(0.0)).otherwise((F.col(column) - low) / span)


def rrf(lists: DataFrame, k: int = Retrieval.rrf_k, top: int = Retrieval.top_k, seed: int = Retrieval.tie_seed) -> DataFrame:
    """Reciprocal-rank fusion of lists told apart by method: a list without the candidate adds nothing."""
    fused = lists.groupBy("query_id", "evidence_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "rank")))).alias("input_ranks"))
    return top_k(fused, top, order_by_score(seed=seed))


def recency(pool: DataFrame, age: Column, seed: int = Retrieval.tie_seed, query: str | list[str] = "query_id") -> DataFrame:
    return rerank(pool.withColumn("score", -age), order_by_score(seed=seed), "recency", query)


def blended_recency(pool: DataFrame, age: Column, tau: Column, weight: Column, seed: int = Retrieval.tie_seed, query: str | list[str] = "query_id") -> DataFrame:
    """Scaled prior score plus ``weight`` times exp(-age / tau)."""
    return rerank(pool.withColumn("score", minmax("score", query) + weight * F.exp(-age / tau)), order_by_score(seed=seed), "bm25_recency", query)


def block_order(pool: DataFrame, suppressed: Column, method: str, query: str | list[str] = "query_id") -> DataFrame:
    """What is not suppressed first, then the rest; each in its old order."""
    return rerank(pool.withColumn("suppressed", suppressed), [F.col("suppressed").asc(), F.col("prior_rank").asc()], method, query)


def by_class(pool: DataFrame, order: tuple[str, ...], method: str, query: str | list[str] = "query_id") -> DataFrame:
    """An oracle: classes in a given order (those not named last), each in its old order."""
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col("class") == name, F.lit(i)).otherwise(place)
    return rerank(pool.withColumn("__place", place), [F.col("__place").asc(), F.col("prior_rank").asc()], method, query).drop("__place")


#: Orders of the two oracles.
CURRENT_FIRST = CLASSES
TEMPORAL = CLASSES[:2] + ("OTHER", "TARGET_OUTDATED")


def newest_tiebreak(pool: DataFrame, on_target: Column, age: Column, seed: int = Retrieval.tie_seed, query: str | list[str] = "query_id") -> DataFrame:
    """A nudge, smaller than any real difference of score, for the newest of the target chain."""
    nudge = F.when(on_target, 1e-6 * (1 - F.least(F.lit(1.0), age / 10_000))).otherwise(F.lit(0.0))
    order = [F.round("score", 12).desc(), tie_key(seed, F.col("query_id"), F.col("evidence_id")).asc()]
    return rerank(pool.withColumn("score", F.col("score") + nudge), order, "newest_tiebreak", query)


def same_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id of every query whose candidates differ between two lists: lost, added or repeated ones."""
    count = lambda df, name: df.groupBy("query_id", "evidence_id").agg(F.count("*").alias(name))
    both = count(a, "x").join(count(b, "y"), ["query_id", "evidence_id"], "full")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("query_id").distinct()


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, ratio): the part of a's candidates that b has too."""
    shared = a.select("query_id", "evidence_id").distinct().join(b.select("query_id", "evidence_id").distinct().withColumn("__in", F.lit(1)), ["query_id", "evidence_id"], "left")
    return shared.groupBy("query_id").agg((F.count("__in") / F.greatest(F.count("*"), F.lit(1))).alias("ratio"))


def prefix_mismatches(short: DataFrame, long: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows of ``short`` that the same rank of ``long`` does not repeat, in id and score."""
    other = long.select("query_id", "rank", F.col("evidence_id").alias("__e"), F.col("score").alias("__s"))
    return short.join(other, ["query_id", "rank"], "left").where(~F.col("evidence_id").eqNullSafe(F.col("__e")) | (F.abs(F.col("score") - F.col("__s")) > tolerance))
