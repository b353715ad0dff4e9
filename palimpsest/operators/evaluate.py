"""Metrics of ranked lists, by query in one aggregation, and reports over many groupings in another."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.pit import graded
from palimpsest.operators.ranking import minmax

K, POOL = 10, 50
KEYS = ["query_id", "method"]


def dcg(gain: Column, rank: Column, k: int = K) -> Column:
    """Discounted gain of ranks up to k, as an aggregate."""
    return F.coalesce(F.sum(F.when(rank <= k, gain / F.log2(rank + 1))), F.lit(0.0))


def ideal_dcg(counts: list[tuple[Column, int]], k: int = K) -> Column:
    """Best possible: ``counts`` are (number of candidates, gain), the largest gain first."""
    total, before = F.lit(0.0), F.lit(0)

    def discounted(first: Column, n: Column, gain: float) -> Column:
        inside = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda r: (r > first) & (r <= first + n))
        return F.aggregate(inside, F.lit(0.0), lambda acc, r: acc + F.lit(gain) / F.log2(r + 1))

    for n, gain in counts:
        total = total + discounted(before, n, float(gain))
        before = before + n
    return total


def per_query(ranked: DataFrame, gold: DataFrame | None = None, k: int = K, pool: int = POOL, keys: list[str] | None = None, prior: str | None = None) -> DataFrame:
    """All metrics of each list (query_id, method, evidence_id, rank, class[, score]).

    gold (query_id, n_current, n_other) has the number of relevant documents that exist; without it those of the list count.
    ``prior`` names the rank in a baseline's list (null if not there): adds what ``suppression`` tells of the two.
    ``recall_at_k`` cuts the list at k; ``recall_list`` takes the first k relevant ones wherever they stand.
    """
    keys = keys or KEYS
    rank, cls = F.col("rank"), F.col("class")
    current, other, stale = cls == "TARGET_CURRENT", cls == "OTHER_SOURCE_CURRENT", cls == "TARGET_OUTDATED"
    aggs = [
        F.count_if(current).cast("int").alias("c_all"), F.count_if(other).cast("int").alias("o_all"), F.count("*").alias("listed"),
        F.count_if(current & (rank <= k)).alias("c_k"), F.count_if(current & (rank <= pool)).alias("c_pool"), F.min(F.when(other, rank)).alias("first_other"), F.min(F.when(current, rank)).alias("first_current"), F.min(F.when(stale, rank)).alias("first_stale"),
        dcg(F.when(current, 1.0).otherwise(0.0), rank, k).alias("dcg"), dcg(graded(cls).cast("double"), rank, k).alias("gdcg"),
        F.count_if(stale & (rank <= k)).alias("outdated_at_k"), F.min_by("class", "rank").alias("top1_class"), F.count_if(stale & (rank <= pool)).alias("stale_pool"),
    ]
    if "score" in ranked.columns:
        aggs += [F.min_by("score", F.when(current, rank)).alias("s_current"), F.min_by("score", F.when(stale, rank)).alias("s_stale")]
    if prior:
        first = F.col(prior) <= k
        aggs += [F.count_if(stale & first).alias("b_out"), F.count_if(stale & first & (rank <= k)).alias("still_out"), F.count_if(current & first).alias("b_cur")]
    a = ranked.groupBy(*keys).agg(*aggs)
    if gold is not None:
        a = a.join(gold, "query_id", "left").withColumns({"n_c": F.coalesce("n_current", F.lit(0)).cast("int"), "n_o": F.coalesce("n_other", F.lit(0)).cast("int")})
    else:
        a = a.withColumns({"n_c": F.col("c_all"), "n_o": F.col("o_all")})
    a = a.withColumns({"idcg": ideal_dcg([(F.col("n_c"), 1)], k), "igdcg": ideal_dcg([(F.col("n_c"), 2), (F.col("n_o"), 1)], k)})
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    metrics = {
        f"ndcg@{k}": ratio("dcg", "idcg"),
        f"gndcg@{k}": ratio("gdcg", "igdcg"),
        f"mrr@{k}": F.when(F.col("first_current") <= k, 1.0 / F.col("first_current")).otherwise(F.lit(0.0)),
        f"recall@{k}": F.when(F.col("n_c") > 0, F.col("c_k") / F.col("n_c")).otherwise(F.lit(0.0)),
        f"recall_list@{k}": F.when(F.col("n_c") > 0, F.least(F.col("c_all"), F.lit(k)) / F.col("n_c")).otherwise(F.lit(0.0)),
        f"stale@{k}": F.when(F.col("listed") > 0, F.col("outdated_at_k") / float(k)).otherwise(F.lit(0.0)),
        f"outdated_count@{k}": F.col("outdated_at_k").cast("double"),
        "first_outdated_rank": F.coalesce("first_stale", F.lit(pool + 1)).cast("double"),
        f"recall@{pool}": F.when(F.col("n_c") > 0, F.col("c_pool") / F.col("n_c")).otherwise(F.lit(0.0)),
        f"current_in_top{pool}": F.col("first_current") <= pool,
        f"current_in_top{k}": F.col("first_current") <= k,
        f"outdated_in_top{pool}": F.col("stale_pool") > 0,
        f"outdated_in_top{k}": F.col("outdated_at_k") > 0,
        f"other_current_in_top{pool}": F.col("first_other") <= pool,
        f"other_current_in_top{k}": F.col("first_other") <= k,
        "top1_current": F.col("top1_class") == "TARGET_CURRENT",
        "top1_outdated": F.col("top1_class") == "TARGET_OUTDATED",
        f"current_at1_no_stale@{k}": (F.col("top1_class") == "TARGET_CURRENT") & (F.col("outdated_at_k") == 0),
    }
    out = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in metrics.items()]
    if "score" in ranked.columns:
        gap = F.col("s_current") - F.col("s_stale")
        out += [(F.abs(gap) < 1e-9).cast("double").alias("tie"), gap.alias("gap")]
    if prior:
        out += [F.when(F.col("b_out") > 0, 1.0 - F.col("still_out") / F.col("b_out")).alias("outdated_suppression"), F.when(F.col("b_cur") > 0, (F.col("c_k") > 0).cast("double")).alias("current_preservation")]
    return a.select(*keys, "top1_class", *out)


def suppression(ranked: DataFrame, baseline: DataFrame, k: int = K) -> DataFrame:
    """(query_id, method, outdated_suppression, current_preservation) against a baseline's top k; null where that has none."""
    base = baseline.where(F.col("rank") <= k).select("query_id", "evidence_id", F.col("class").alias("b"))
    top = ranked.where(F.col("rank") <= k).select("query_id", "method", "evidence_id", "class")
    methods = ranked.select("query_id", "method").distinct()
    held = methods.join(base, "query_id", "left").join(top.select("query_id", "method", "evidence_id", F.lit(1).alias("still")), ["query_id", "method", "evidence_id"], "left")
    counts = held.groupBy("query_id", "method").agg(F.count_if(F.col("b") == "TARGET_OUTDATED").alias("b_out"), F.count_if((F.col("b") == "TARGET_OUTDATED") & F.col("still").isNotNull()).alias("still_out"), F.count_if(F.col("b") == "TARGET_CURRENT").alias("b_cur"))
    now = top.groupBy("query_id", "method").agg(F.count_if(F.col("class") == "TARGET_CURRENT").alias("cur"))
    both = counts.join(now, ["query_id", "method"], "left")
    return both.select(
        "query_id", "method", F.when(F.col("b_out") > 0, 1.0 - F.col("still_out") / F.col("b_out")).alias("outdated_suppression"),
        F.when(F.col("b_cur") > 0, (F.coalesce("cur", F.lit(0)) > 0).cast("double")).alias("current_preservation"),
    )


def summary(metrics: DataFrame, by: list[str] | None = None, k: int = K, pool: int = POOL) -> DataFrame:
    """The means that a report of ranked lists shows, from ``per_query`` with scores, by ``by`` (method). Ties and gaps count where both classes are listed."""
    is_ = lambda c: F.col(f"`{c}`") > 0
    rate = lambda test, name: F.avg(test.cast("double")).alias(name)
    mean = lambda c, name: F.avg(f"`{c}`").alias(name)
    listed, top = is_(f"current_in_top{pool}"), is_(f"current_in_top{k}")
    return metrics.groupBy(*(by or ["method"])).agg(
        F.count("*").alias("queries"), mean(f"recall@{k}", "recall_k"), mean(f"recall@{pool}", "recall_pool"), mean(f"mrr@{k}", "mrr"), mean(f"ndcg@{k}", "ndcg"), mean(f"gndcg@{k}", "ndcg_graded"), mean(f"stale@{k}", "stale"),
        rate(~listed, "retrieval_failure"), rate(listed & ~top, "ranking_failure"), rate(is_(f"outdated_in_top{pool}"), "outdated_in_pool"), rate(is_(f"outdated_in_top{k}"), "outdated_in_k"),
        rate(listed & is_(f"outdated_in_top{pool}"), "both_in_pool"), rate(is_(f"other_current_in_top{pool}"), "other_current_in_pool"), rate(top & is_(f"outdated_in_top{k}"), "both_in_k"), rate(is_(f"other_current_in_top{k}"), "other_current_in_k"),
        mean("top1_current", "top1_current"), mean("top1_outdated", "top1_outdated"), mean("tie", "tie_rate"), mean("gap", "mean_gap"), F.count("gap").alias("both_listed"),
    )


def staleness(metrics: DataFrame, suppressed: DataFrame | None, k: int = K, pool: int = POOL) -> DataFrame:
    """By method: where the first outdated candidate stands, and what was suppressed and preserved (see ``suppression``), each over the queries that define it.

    Without ``suppressed`` the metrics have these columns already.
    """
    both = metrics if suppressed is None else metrics.join(suppressed, KEYS, "left")
    first = F.col("first_outdated_rank")
    means = both.groupBy("method").agg(
        F.count("*").alias("queries"), F.avg(f"`outdated_count@{k}`").alias("outdated_count"), F.avg(first).alias("first_outdated_mean"), F.avg((first > k).cast("double")).alias("beyond_k"), F.avg((first > pool).cast("double")).alias("not_in_pool"),
        F.avg("outdated_suppression").alias("suppression"), F.count("outdated_suppression").alias("suppression_queries"), F.avg("current_preservation").alias("preservation"), F.count("current_preservation").alias("preservation_queries"), F.avg(f"`current_at1_no_stale@{k}`").alias("joint"),
    )
    # The upper median: ranks are whole numbers up to pool + 1, so they are counted.
    counted = both.groupBy("method", first.alias("r")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("method").orderBy("r")
    upto = counted.withColumns({"upto": F.sum("c").over(order), "all": F.sum("c").over(Window.partitionBy("method"))})
    median = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("method").agg(F.min("r").alias("first_outdated_median"))
    return means.join(median, "method")


def grid_on_dev(pool: DataFrame, age: Column, taus: tuple[float, ...], weights: tuple[float, ...], order: Callable[[Column], list[Column]], k: int = K, query: list[str] | None = None) -> DataFrame:
    """(tau, weight, ndcg, stale, place) of every setting of the blended recency reranker on a pool of dev questions, the best first.

    Best: the largest ndcg, then the least stale, then the smaller settings. ``order`` gives a list's total order by a score.
    """
    query = query or ["query_id"]
    scaled = pool.withColumn("__s", minmax("score", query))
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(float(w)).alias("weight")) for t in taus for w in weights]))
    each = scaled.withColumn("__g", grid).select("*", "__g.*").withColumn("score", F.col("__s") + F.col("weight") * F.exp(-age / F.col("tau")))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(*query, "tau", "weight").orderBy(*order(F.col("score")))))
    means = per_query(ranked, k=k, keys=[*query, "tau", "weight"]).groupBy("tau", "weight").agg(F.avg(f"`ndcg@{k}`").alias("ndcg"), F.avg(f"`stale@{k}`").alias("stale"))
    best = Window.orderBy(F.round("ndcg", 9).desc(), F.round("stale", 9), "tau", "weight")  # a row for each setting
    return means.withColumn("place", F.row_number().over(best))


def long(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value)."""
    return metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("x")).select(*keys, "x.metric", "x.value")


def report(rows: DataFrame, metrics: list[str], dimensions: list[str], by: str = "method") -> DataFrame:
    """One mean of each metric for all, and for each value of each dimension, in one pass by grouping sets.

    grouping names the dimension ("all" for none), value its value. A null metric counts in no mean.
    """
    sets = [[F.col(by)]] + [[F.col(by), F.col(d)] for d in dimensions]
    aggs = [F.count("*").alias("queries"), *[F.avg(f"`{m}`").alias(m) for m in metrics], *[F.count(f"`{m}`").alias(f"{m}_n") for m in metrics]]
    grouped = rows.groupingSets(sets, by, *dimensions).agg(*aggs, *[F.grouping(d).alias(f"__g_{d}") for d in dimensions])
    which = reduce(lambda acc, d: F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(acc), dimensions, F.lit("all"))
    value = reduce(lambda acc, d: F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(acc), dimensions, F.lit("all"))
    return grouped.select(by, which.alias("grouping"), value.alias("value"), "queries", *metrics, *[f"{m}_n" for m in metrics])


def at_place(rows: DataFrame, by: list[str], value: str, **places: Callable[[Column], Column]) -> DataFrame:
    """(by, one column for each place): elements of each group's sorted values. A place tells an index from 0 by the number of values.

    Equal values are counted first; nulls are left out. A group is counted up in order and never collected.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    so_far = counted.withColumns({"__upto": F.sum("__n").over(group.orderBy("__v")), "__all": F.sum("__n").over(group)})
    at = lambda place: (place(F.col("__all")) >= F.col("__upto") - F.col("__n")) & (place(F.col("__all")) < F.col("__upto"))
    return so_far.groupBy(*by).agg(*[F.max(F.when(at(place), F.col("__v"))).alias(name) for name, place in places.items()])


def lower_quantile(p: float) -> Callable[[Column], Column]:
    """Place floor(p n), at most the last: below the interpolated quantile."""
    return lambda n: F.least(n - 1, F.floor(F.lit(p) * n))


def upper_median(n: Column) -> Column:
    """The place of the median; of an even number of values that of the upper one."""
    return F.floor(n / 2)
