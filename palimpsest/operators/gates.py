"""Invariants as one aggregation: each is a condition that no row may break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import Queries
from palimpsest.functions import text


def check(frame: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """(gate, violations, passed) of every condition, in one pass."""
    counts = frame.agg(*[F.count_if(test).alias(name) for name, test in bad.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"`{n}`").alias("violations")) for n in bad]))
    return counts.select(each.alias("x")).select("x.gate", "x.violations", (F.col("x.violations") == 0).alias("passed"))


def require(gates: DataFrame) -> None:
    """Refuse to go on if a gate has not passed."""
    if failed := [r["gate"] for r in gates.where(~F.col("passed")).collect()]:
        raise RuntimeError(f"gates failed: {failed}")


def list_gates(ranked: DataFrame, at: str = "query_time", observed: str = "observed_from", keys: list[str] | None = None) -> DataFrame:
    """Gates of ranked lists: nothing from the future, no NaN, no candidate twice, ranks without gaps."""
    per = ranked.groupBy(*(keys or ["query_id", "method"])).agg(
        F.count_if(F.col(observed) > F.col(at)).alias("future"), F.count_if(F.isnan("score")).alias("nan"), (F.count("*") - F.count_distinct("evidence_id")).alias("twice"), (F.max("rank") != F.count("*")).alias("gap")
    )
    return check(per, {"visibility": F.col("future") > 0, "nan_scores": F.col("nan") > 0, "duplicates": F.col("twice") > 0, "rank_gaps": F.col("gap")})


def corpus_gates(evidence: DataFrame, queries: DataFrame, window: tuple[int, int], counts: dict[str, int] | None = None, forbidden: tuple[str, ...] = Queries().forbidden) -> DataFrame:
    """Nineteen invariants of a corpus and its questions, as (gate, violations, passed); the one on ``counts`` (questions by split) only if given.

    evidence: as of ``corpus.documents``; queries: as of ``pit.generate_queries``; window: first and last instant. What is null where a
    value is needed breaks its gate, so does an answer or a visible document that is not in the corpus. Empty tables break none.
    """
    bad = lambda good: ~F.coalesce(good, F.lit(False))
    some = lambda name: F.max(F.coalesce(F.col("split") == name, F.lit(False)))
    main, censored = F.col("query_role") == "POST_REPLACEMENT_MAIN", F.coalesce(F.col("valid_from_censored"), F.lit(False))

    rows = check(
        evidence,
        {
            "text_without_label_words": bad(~text.contains_any(F.col("evidence_text"), forbidden)),
            "text_without_successor": F.contains("evidence_text", F.col("replaced_by_evidence_id")),
            "censored_sentence": bad(F.startswith("evidence_text", F.lit("At the beginning of the observation window")) == censored),
            "start_is_an_activation": ~censored & (F.col("valid_from").isNull() | F.col("activation_event_id").isNull()),
        },
    )
    ids = check(evidence.groupBy("evidence_id").agg(F.count("*").alias("n")), {"evidence_ids_unique": F.col("n") > 1})
    asked = queries.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), (some("future_event") & some("test")).alias("both"))
    asked = check(asked, {"query_ids_unique": F.col("n") > 1, "one_split": F.col("splits") != 1, "future_events_not_in_test": F.col("both")})
    entities = queries.groupBy("cve_id").agg((some("test") & (some("train") | some("dev"))).alias("both"))
    entities = check(entities, {"test_entities_apart": F.col("both")})

    known = ("cve_id", "source_key", "cvss_version", "base_vector", "base_score", "bt_score")
    target = evidence.select(F.col("evidence_id").alias("answer_evidence_id"), *[F.col(c).alias(f"__{c}") for c in known])
    new = evidence.select(F.col("evidence_id").alias("replacing_new_evidence_id"), F.col("valid_until").alias("__until"))
    joined = queries.join(target, "answer_evidence_id", "left").join(new, "replacing_new_evidence_id", "left")
    score, base, bt = F.col("answer_base_score"), F.col("__base_score"), F.col("__bt_score")
    same = (F.col("cve_id") == F.col("__cve_id")) & (F.col("source_key") == F.col("__source_key")) & (F.col("cvss_version") == F.col("__cvss_version"))
    answers = check(
        joined,
        {
            "target_in_its_chain": bad(same),
            "main_has_current": main & bad(F.size("current_evidence_ids") > 0),
            "main_has_outdated": main & bad(F.size("outdated_evidence_ids") > 0),
            "times_in_window": bad(F.col("query_time").between(*map(F.lit, window))),
            "answer_is_the_documents": bad((F.col("answer_base_vector") == F.col("__base_vector")) & (score == base)),
            "answer_is_not_the_threat_score": bad((score == base) & (bt.isNull() | (score != bt) | (bt == base))),
            "one_current_target": bad(~F.col("multiple_current_targets")),
            "before_the_next_replacement": main & F.coalesce(F.col("query_time") >= F.col("__until"), F.lit(False)),
        },
    )
    seen = queries.select("query_time", F.explode("visible_evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "observed_from"), "evidence_id", "left")
    future = check(seen, {"nothing_from_the_future": bad(F.col("observed_from") <= F.col("query_time"))})
    out = rows
    for part in (ids, asked, entities, answers, future):
        out = out.unionByName(part)
    if counts is not None:
        listed = queries.sparkSession.createDataFrame(sorted(counts.items()), "split string, expected long")
        both = queries.groupBy("split").agg(F.count("*").alias("n")).join(listed, "split", "full")
        wrong = F.coalesce(F.col("n"), F.lit(0)) != F.coalesce(F.col("expected"), F.lit(0))
        out = out.unionByName(check(both, {"counts_as_listed": wrong}))
    return out
