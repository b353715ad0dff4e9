"""What a rule did to its lists: counts over candidates, over pairs with their witnesses and over questions, and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.pit import CLASSES

STALE = "TARGET_OUTDATED"


def _named(frame: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """(counter, value) of several aggregates, in one pass."""
    one = frame.agg(*[c.cast("double").alias(name) for name, c in counts.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(f"`{name}`").alias("value")) for name in counts]))
    return one.select(each.alias("x")).select("x.*")


def rule_counts(listed: DataFrame, documents: DataFrame, chain: list[str], value: str, observed: str, at: str = "query_time", k: int = 10, flags: dict[str, Column] | None = None, witness_flags: dict[str, Column] | None = None) -> DataFrame:
    """(counter, value) of a rule's lists.

    ``listed`` has query_id, evidence_id, class, rank, suppressed, witness, other_rank (in the list of another rule), chain, value and at.
    ``documents`` has evidence_id, chain, value and observed. ``flags`` are conditions on candidates, each counted over all and over the
    suppressed ones; ``witness_flags`` are conditions on witnesses. Only candidates with a witness are joined, so the many without one
    don't meet in one task. Empty lists count 0; means and rates of nothing are null.
    """
    known = {"__value": F.col(value), "__chain": F.struct(*chain), "__at": F.col(observed)} | {f"__{name}": test for name, test in (witness_flags or {}).items()}
    seen = documents.select(F.col("evidence_id").alias("witness"), *[c.alias(name) for name, c in known.items()])
    has = F.col("suppressed") & F.col("witness").isNotNull()
    met = listed.where(has).join(seen, "witness").unionByName(listed.where(~F.coalesce(has, F.lit(False))), allowMissingColumns=True)
    return counts_of(met, chain, value, ("__value", "__chain", "__at"), at, k, flags, {name: F.col(f"__{name}") for name in witness_flags or {}})


def counts_of(listed: DataFrame, chain: list[str], value: str, known: tuple[str, str, str], at: str = "query_time", k: int = 10, flags: dict[str, Column] | None = None, witness_flags: dict[str, Column] | None = None, query: list[str] | None = None) -> DataFrame:
    """``rule_counts`` of lists that have the value, chain and time of their witnesses already, in the columns ``known``: one pass, by question (told by ``query``) and over all."""
    gone, top, stale = F.col("suppressed"), F.col("rank") <= k, F.col("class") == STALE
    over = {"candidates": F.count("*"), "suppressed": F.count_if(gone)}
    for name in CLASSES:
        over |= {f"candidates_{name}": F.count_if(F.col("class") == name), f"suppressed_{name}": F.count_if(gone & (F.col("class") == name))}
    for name, test in (flags or {}).items():
        over |= {f"candidates_{name}": F.count_if(test), f"suppressed_{name}": F.count_if(gone & test)}
    seen = gone & F.col("witness").isNotNull()
    by = {
        "witness_of_same_value": F.count_if(seen & (F.col(known[0]) == F.col(value))),
        "witness_of_other_chain": F.count_if(seen & (F.col(known[1]) != F.struct(*chain))),
        "witness_from_the_future": F.count_if(seen & (F.col(known[2]) > F.col(at))),
    }
    by |= {f"witness_{name}": F.count_if(seen & test) for name, test in (witness_flags or {}).items()}
    sums = over | by
    asked = listed.groupBy(*(query or ["query_id"])).agg(
        F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept"), F.count_if(top & stale).alias("stale"), F.count_if(top & stale & gone).alias("forced"),
        F.min(F.col("rank") == F.col("other_rank")).alias("same"), *[c.alias(f"c_{name}") for name, c in sums.items()],
    )
    enough = F.col("kept") >= k
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of = {
        "queries": F.count("*"), "queries_with_signal": F.count_if(F.col("gone") > 0), "queries_with_capacity": F.count_if(enough), "queries_without_capacity": F.count_if(~enough),
        "queries_with_forced_stale": F.count_if(F.col("forced") > 0), "queries_with_same_list": F.count_if("same"), "stale_at_k": total("stale"), "forced_stale_at_k": total("forced"),
        "stale_at_k_with_capacity": total(F.when(enough, F.col("stale"))), "mean_suppressed": F.avg("gone"), "stale_rate_with_capacity": F.avg(F.when(enough, F.col("stale") / k)),
    }
    return _named(asked, {name: total(f"c_{name}") for name in sums} | of)


def examples(listed: DataFrame, kinds: dict[str, Column], n: int = 5) -> DataFrame:
    """(kind, n, query_id, evidence_id, rank): of each kind the first questions by id, each with its candidate of the best rank."""
    which = F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in kinds.items()]), lambda x: x.isNotNull()))
    first = listed.select(which.alias("kind"), "query_id", "rank", "evidence_id").groupBy("kind", "query_id").agg(F.min(F.struct("rank", "evidence_id")).alias("x"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("query_id"))
    return first.select("kind", place.alias("n"), "query_id", "x.evidence_id", "x.rank").where(F.col("n") <= n)
