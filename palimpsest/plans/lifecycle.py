"""The engine end to end: change log to intervals, intervals to questions, questions to ranked and judged lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.config import Queries, Retrieval, Splits, Statistics, Timeline
from palimpsest.functions import text, times
from palimpsest.operators import corpus, evaluate, gates, pit, ranking, replay, retrieval, splits, stats, timeline
from palimpsest.session import kept, prepare
from palimpsest.sources import changelog


def build_timeline(spark: SparkSession, history: str, out: str, cfg: Timeline = Timeline(), glob: str = "*.json") -> dict[str, DataFrame]:
    """Change-history pages in ``history`` to intervals, chain reports, cross-event replacements, candidates and issues under ``out``."""
    prepare(spark)
    pages = changelog.read_texts(spark, history, glob)
    records = changelog.records(pages)
    intervals, reports, crossings = timeline.replay(timeline.chain_events(records, cfg), cfg)
    parts = {"intervals": intervals, "chain_reports": reports, "cross_events": crossings, "replacements": timeline.replacements(records, cfg), "issues": changelog.issues(pages)}
    for name, frame in parts.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in parts}


def build_corpus(spark: SparkSession, intervals: DataFrame, out: str, lookup: Column | None = None, cfg: Splits = Splits(), q: Queries = Queries()) -> dict[str, DataFrame]:
    """Splits, documents and point-in-time questions of intervals, under ``out``."""
    prepare(spark)
    events = pit.replacement_events(intervals)
    seen = splits.periods(events, "cve_id", "year", cfg)
    dev = splits.seeded_sample(seen.where("in_train").select("cve_id"), "cve_id", cfg.dev_fraction, cfg.seed)
    assigned = splits.assign(intervals.select("cve_id"), seen, "cve_id", dev)
    # Written before it is filtered: a filter pushed below the rendering would compute scores and sentences once for each rule.
    corpus.documents(intervals, assigned, lookup).write.mode("overwrite").parquet(f"{out}/documents")
    accepted, excluded = corpus.admit(spark.read.parquet(f"{out}/documents"), corpus.eligibility(q.forbidden))
    asked = splits.event_splits(events.where("base_components_changed"), assigned, "cve_id", "year", cfg)
    drawn = splits.seeded_choice(asked.select(F.concat_ws("|", "termination_event_id", "old_evidence_id").alias("k")), "k", q.templates, q.seed, "query_template_id")
    templates = drawn.select(F.regexp_replace("k", r"^[^|]*\|", "").alias("old_evidence_id"), "query_template_id")
    window = Timeline()
    bounds = tuple(int(pd.Timestamp(x).value // 1000) for x in (window.window_start, window.window_end))
    questions, left_out = pit.generate_queries(asked, accepted, templates, bounds, q)
    parts = {"splits": assigned, "corpus": accepted, "excluded_intervals": excluded, "queries": questions, "excluded_queries": left_out, "excluded_events": pit.excluded_events(intervals)}
    for name, frame in parts.items():
        (frame.write.mode("overwrite").partitionBy("split") if name == "queries" else frame.write.mode("overwrite")).parquet(f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in parts}


def audit_corpus(spark: SparkSession, out: str, counts: dict[str, int] | None = None, q: Queries = Queries(), window: Timeline = Timeline()) -> DataFrame:
    """The gates of the corpus and questions under ``out``, written there; raises if one has not passed."""
    prepare(spark)
    bounds = tuple(int(pd.Timestamp(x).value // 1000) for x in (window.window_start, window.window_end))
    gates.corpus_gates(spark.read.parquet(f"{out}/corpus"), spark.read.parquet(f"{out}/queries"), bounds, counts, q.forbidden).write.mode("overwrite").parquet(f"{out}/gates")
    made = spark.read.parquet(f"{out}/gates")
    gates.require(made)
    return made


def judge(lists: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds label, relation and class to (query_id, evidence_id, ...)."""
    q = queries.select("query_id", F.col("cve_id").alias("q_cve"), F.col("source_key").alias("q_source"), F.col("cvss_version").alias("q_version"), "query_time")
    d = documents.select("evidence_id", "cve_id", "source_key", "cvss_version", "observed_from", "valid_until", "replacement_type", "chain_ambiguous", "base_vector", "valid_from_censored", "replaced_by_evidence_id")
    j = lists.join(q, "query_id").join(d, "evidence_id")
    on = pit.target_chain(F.col("q_cve"), F.col("q_source"), F.col("q_version"), F.col("cve_id"), F.col("source_key"), F.col("cvss_version"))
    live = pit.active(F.col("observed_from"), F.col("valid_until"), F.col("query_time"))
    j = j.withColumns({"on_target": on, "label": pit.label(pit.visible(F.col("observed_from"), F.col("query_time")), F.col("chain_ambiguous"), on, live, F.col("replacement_type") == "STRICT_SAME_CHANGE")})
    j = j.withColumn("relation", pit.relation(F.col("cve_id") == F.col("q_cve"), on, live, F.col("chain_ambiguous")))
    return j.withColumn("class", pit.candidate_class(F.col("label"), F.col("relation")))


def tokens(of: str) -> Column:
    """What is retrieved by: a document is its identity and its sentence (evidence_text), a question its chain and its text (query_text)."""
    return text.tokenize(F.concat_ws(" ", "cve_id", "source_key", "cvss_version", of))


def retrieve(queries: DataFrame, documents: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    """Judged BM25 lists."""
    found = retrieval.bm25(documents, queries, tokens("evidence_text"), tokens("query_text"), cfg=cfg).withColumn("method", F.lit("bm25"))
    return judge(found, queries, documents)


def hybrid(lexical: DataFrame, queries: DataFrame, documents: DataFrame, encoder, revision: str, cfg: Retrieval = Retrieval()) -> DataFrame:
    """Judged fusion of BM25 lists with dense lists by an encoder."""
    d = retrieval.encode(documents, "evidence_id", "evidence_text", encoder, revision).join(documents.select("evidence_id", "observed_from"), "evidence_id")
    q = retrieval.encode(queries, "query_id", "query_text", encoder, revision).withColumnRenamed("evidence_id", "query_id").join(queries.select("query_id", "query_time"), "query_id")
    dense = retrieval.dense(d, q, cfg.dense_top_k, "observed_from", "query_time").withColumn("method", F.lit("dense"))
    columns = ["query_id", "evidence_id", "rank", "method"]
    fused = ranking.rrf(lexical.select(*columns).unionByName(dense.select(*columns)), cfg.rrf_k, cfg.top_k)
    return judge(fused.withColumn("method", F.lit("hybrid")), queries, documents)


def rerank_by_rules(pool: DataFrame, documents: DataFrame) -> DataFrame:
    """The pool under all rules and oracles, as one table of lists told apart by method. The pool is computed once."""
    pool = kept(pool)
    chain = ["cve_id", "cvss_version", "source_key"]
    view = corpus.reranker_view(documents)
    witnesses = view.join(documents.where(F.col("replacement_type") == replay.CROSS).select("evidence_id"), "evidence_id", "left_anti")
    blind = pool.withColumn("canonical_base_vector", F.col("base_vector"))
    flagged = pit.first_witness(blind, witnesses, chain, "observed_from", "evidence_id", "canonical_base_vector", "query_time", ["query_id", "evidence_id"])
    flagged = pit.direct_link(flagged, documents, F.col("replaced_by_evidence_id"), "evidence_id", "observed_from", "query_time")
    age = times.age_days(F.col("query_time"), F.col("observed_from"))
    lists = [
        pool, ranking.recency(pool, age), ranking.blended_recency(pool, age, F.lit(30.0), F.lit(0.5)), ranking.block_order(flagged, F.col("superseded"), "rule_corpus"),
        ranking.block_order(flagged, F.col("superseded") & F.col("on_target"), "rule_target"), ranking.block_order(flagged, F.col("direct"), "rule_direct"),
        ranking.by_class(pool, ranking.CURRENT_FIRST, "oracle_current_first"), ranking.by_class(pool, ranking.TEMPORAL, "oracle_temporal"),
    ]
    columns = ["query_id", "method", "evidence_id", "rank", "score", "class", "query_time", "observed_from"]
    out = lists[0].select(*columns)
    for each in lists[1:]:
        out = out.unionByName(each.select(*columns))
    return out


def evaluate_lists(lists: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of each list, report by split, template, censoring and version)."""
    gold = queries.select("query_id", F.size("current_evidence_ids").alias("n_current"), F.size("other_source_current_evidence_ids").alias("n_other"))
    metrics = evaluate.per_query(lists, gold)
    dims = queries.select("query_id", "split", "query_template_id", F.col("valid_from_censored").cast("string").alias("censored"), "cvss_version")
    names = ["ndcg@10", "gndcg@10", "mrr@10", "recall@10", "stale@10", "first_outdated_rank", "top1_current", "current_at1_no_stale@10"]
    return metrics, evaluate.report(metrics.join(dims, "query_id"), names, ["split", "query_template_id", "censored", "cvss_version"])


def significance(metrics: DataFrame, queries: DataFrame, baseline: str, names: tuple[str, ...], cfg: Statistics = Statistics()) -> tuple[DataFrame, DataFrame]:
    """(intervals, tests): the mean of each method and metric with its bootstrap interval, and every method against the baseline on every metric.

    Entities are the clusters, drawn the same way for all; the tests are one family for Holm's correction. Metrics: as of ``evaluate_lists``.
    """
    values = evaluate.long(metrics.join(queries.select("query_id", "cve_id"), "query_id"), ["query_id", "cve_id", "method"], list(names))
    sums = kept(stats.cluster_sums(values, "cve_id", ["method", "metric"]))
    replicates = kept(stats.bootstrap_by_hash(sums, "cve_id", ["method", "metric"], cfg.replicates))
    means = sums.groupBy("method", "metric").agg((F.sum("total") / F.sum("n")).alias("mean"))
    tests = stats.paired_differences(replicates, baseline, ["metric"], cfg.level).withColumn("test", F.concat_ws("|", "method", "metric"))
    return means.join(stats.intervals(replicates, ["method", "metric"], cfg.level), ["method", "metric"]), stats.holm(tests, alpha=cfg.alpha)


def sample_queries(queries: DataFrame, per_split: int = 100, seed: int = 20260917) -> DataFrame:
    """Of so many entities of each split, chosen by a hash, the question with the least id."""
    entities = queries.select("split", "cve_id").distinct()
    order = Window.partitionBy("split").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "cve_id").cast("binary")))
    chosen = entities.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_split).drop("n")
    return queries.join(chosen, ["split", "cve_id"], "left_semi").groupBy("split", "cve_id").agg(F.min("query_id").alias("query_id"))
