"""Other cohorts of questions: the same ones asked later, retrieved again from a stored index, and those asked before the replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import DAY, Retrieval
from palimpsest.functions import text, times
from palimpsest.operators import gates, pit, ranking, retrieval
from palimpsest.plans import lifecycle
from palimpsest.plans.catalogue import query
from palimpsest.plans.ranked import _BMQ, _TIE
from palimpsest.session import shared_dir
from palimpsest.sources import adapters as A
from palimpsest.sources.adapters import A2, A6, WINDOW_END, WINDOW_START

#: Days after a value came into force at which the questions of a cohort are asked.
OFFSETS = (1, 30, 90, 180, 365)


def asked_later(queries: DataFrame, documents: DataFrame, window_end: int, days: tuple[int, ...] = OFFSETS) -> tuple[DataFrame, DataFrame]:
    """(questions, excluded): every question ``days`` after its current evidence came into force, one cohort for each.

    Question ids carry the cohort, so that ties are broken within it; original_id and original_time keep the first ones. Excluded are, with
    the reason, questions whose evidence has ended by then, or that would be asked after ``window_end``.
    """
    current = documents.select(F.col("evidence_id").alias("answer_evidence_id"), F.col("valid_from").alias("__from"), F.col("valid_until").alias("__until"))
    each = queries.join(current, "answer_evidence_id").withColumn("offset_days", F.explode(F.array(*[F.lit(d).cast("long") for d in days])))
    moved = each.withColumn("__w", times.retime(F.col("__from"), F.col("__until"), F.lit(window_end), F.col("offset_days")))
    excluded = moved.where(F.col("__w.at").isNull()).select("offset_days", "query_id", F.col("__w.reason").alias("reason"))
    at = F.col("__w.at")
    again = text.query_text(F.col("query_template_id"), times.date_of(at), F.col("cvss_version"), F.col("source_key"), F.col("cve_id"))
    kept = moved.where(at.isNotNull()).withColumns({"original_id": F.col("query_id"), "original_time": F.col("query_time"), "query_text": again, "query_time": at, "query_id": F.concat_ws("+", "query_id", "offset_days")})
    return kept.drop("__from", "__until", "__w"), excluded


def pool_overlap(lists: DataFrame, original: DataFrame) -> DataFrame:
    """(query_id, offset_days, candidates, overlap): which part of a later list stands in the original one of its question."""
    first = original.select(F.col("query_id").alias("original_id"), "evidence_id", F.lit(1).alias("__there"))
    met = lists.join(first, ["original_id", "evidence_id"], "left")
    return met.groupBy("query_id", "offset_days").agg(F.count("*").alias("candidates"), (F.count("__there") / F.count("*")).alias("overlap"))


def reretrieved(index: retrieval.Index, cohorts: DataFrame, query_tokens, original: DataFrame, observed: DataFrame, cfg: Retrieval = Retrieval()) -> tuple[DataFrame, DataFrame]:
    """(lists, overlap) of ``cohorts`` (query_id, original_id, offset_days, query_time) by one stored index; gates on the lists must pass.

    ``observed``: evidence_id and observed_from of the documents.
    """
    found = retrieval.bm25(index, cohorts, None, query_tokens, cfg=cfg)
    lists = found.join(cohorts.select("query_id", "original_id", "offset_days", "query_time"), "query_id").join(observed, "evidence_id").withColumn("method", F.lit("bm25"))
    gates.require(gates.list_gates(lists))
    return lists, pool_overlap(lists, original)


def control_checks(lists: DataFrame, controls: DataFrame, by: list[str]) -> DataFrame:
    """What must hold of questions asked before their replacement, counted by ``by``, and how well they are answered.

    lists: query_id, evidence_id, rank, class, observed_from; controls: query_id, query_time, new_evidence_id and ``by``. Nothing in a list may be from the future,
    so the evidence that later replaced the answer can't be there.
    """
    each = lists.join(controls, "query_id")
    current = F.col("class") == "TARGET_CURRENT"
    per = each.groupBy("query_id", *by).agg(
        F.count_if(F.col("observed_from") > F.col("query_time")).alias("late"), F.max((F.col("evidence_id") == F.col("new_evidence_id")).cast("int")).alias("replacing"),
        F.max(current.cast("int")).alias("current"), F.max((F.col("class") == "TARGET_OUTDATED").cast("int")).alias("outdated"), F.min(F.when(current & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.count_if((F.col("class") == "TARGET_OUTDATED") & (F.col("rank") <= 10)).alias("stale"), F.count("*").alias("candidates"),
    )
    return per.groupBy(*by).agg(
        F.count("*").alias("queries"), F.sum("late").alias("visibility_violations"), F.sum("replacing").alias("replacing_in_pool"), F.sum("current").alias("current_in_pool"), F.sum("outdated").alias("outdated_in_pool"),
        F.avg("candidates").alias("candidates"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("stale") / 10.0).alias("stale"), F.avg(F.coalesce(F.col("first") == 1, F.lit(False)).cast("double")).alias("top1_current"),
    )


def run(spark: SparkSession, documents: DataFrame, queries: DataFrame, out: str, window_end: int, days: tuple[int, ...] = OFFSETS) -> dict[str, DataFrame]:
    """The main questions asked again at later times, and the control questions, by one index stored under ``out``.

    Written: index, offset_lists (by cohort), offset_overlap, offset_excluded, control_lists and control_report (by split and whether the answer is from before the window).
    """
    retrieval.index(documents, lifecycle.tokens("evidence_text")).save(f"{out}/index")
    index, asked = retrieval.Index.load(spark, f"{out}/index"), lifecycle.tokens("query_text")
    main = queries.where(F.col("query_role") == "POST_REPLACEMENT_MAIN")
    original = retrieval.bm25(index, main, None, asked)
    later, excluded = asked_later(main, documents, window_end, days)
    lists, overlap = reretrieved(index, later, asked, original, documents.select("evidence_id", "observed_from"))
    controls = queries.where(F.col("query_role") == "PRE_REPLACEMENT_CONTROL")
    found = lifecycle.judge(retrieval.bm25(index, controls, None, asked).withColumn("method", F.lit("bm25")), controls, documents)
    by = ["split", "valid_from_censored"]
    told = controls.select("query_id", "query_time", F.col("replacing_new_evidence_id").alias("new_evidence_id"), *by)
    parts = {"offset_lists": lists, "offset_overlap": overlap, "offset_excluded": excluded, "control_lists": found, "control_report": control_checks(found.select("query_id", "evidence_id", "rank", "class", "observed_from"), told, by)}
    for name, frame in parts.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in parts}


_DAYS = (0, 1, 2, 5)
_LATER = "a6 AS (SELECT item_id || '+' || days AS query_id, text, days, CAST(item_id AS VARCHAR) AS original_id, {start} + (item_id + 1 + days) * {day} AS query_time FROM benchmark, (SELECT unnest([{days}])::BIGINT AS days))".format(start=WINDOW_START, day=DAY, days=", ".join(map(str, _DAYS)))


@query(f"WITH {_BMQ.replace(A6, _LATER)}, lst AS (SELECT bm.*, days, original_id, observed_from, query_time FROM bm JOIN a6 USING (query_id) JOIN a5 USING (evidence_id)), fst AS (SELECT original_id, evidence_id FROM lst WHERE days = 0), per AS (SELECT l.query_id, l.days, count(*) AS n, count(f.evidence_id) * 1.0::DOUBLE / count(*) AS overlap, count(*) FILTER (WHERE l.observed_from > l.query_time - l.days * {DAY}) AS newer FROM lst l LEFT JOIN fst f ON f.original_id = l.original_id AND f.evidence_id = l.evidence_id GROUP BY 1, 2) SELECT days, count(*) AS queries, CAST(sum(n) AS BIGINT) AS candidates, round(avg(overlap), 6) AS overlap, CAST(sum(newer) AS BIGINT) AS newly_visible FROM per GROUP BY 1")
def offset_retrieval(spark, sf):
    """The items asked again some days later, all cohorts by one index that was stored and loaded."""
    t = text.tokenize(F.col("text"))
    path = f"{shared_dir(spark)}/palimpsest-index-{uuid.uuid4().hex}"
    documents = A.documents(spark, sf)
    retrieval.index(documents, t).save(path)
    stored = retrieval.Index.load(spark, path)
    first = A.text_queries(spark, sf).withColumn("original_id", F.col("query_id")).withColumn("offset_days", F.explode(F.array(*[F.lit(d).cast("long") for d in _DAYS])))
    cohorts = first.withColumns({"query_id": F.concat_ws("+", "original_id", "offset_days"), "query_time": F.col("query_time") + F.col("offset_days") * DAY})
    observed = documents.select("evidence_id", "observed_from")
    base = retrieval.bm25(stored, cohorts.where("offset_days = 0"), None, t)
    original = base.withColumn("query_id", F.split_part("query_id", F.lit("+"), F.lit(1)))
    lists, overlap = reretrieved(stored, cohorts, t, original, observed)
    newer = lists.where(F.col("observed_from") > F.col("query_time") - F.col("offset_days") * DAY).groupBy("offset_days").agg(F.count("*").alias("newly_visible"))
    sums = overlap.groupBy("offset_days").agg(F.count("*").alias("queries"), F.sum("candidates").alias("candidates"), F.avg("overlap").alias("overlap"))
    return sums.join(newer, "offset_days", "left").select(F.col("offset_days").alias("days"), "queries", "candidates", "overlap", F.coalesce("newly_visible", F.lit(0)).alias("newly_visible"))


_CONTROL = f"""{A2}, old AS (SELECT *, lead(evidence_id) OVER (PARTITION BY entity, source ORDER BY seq) AS new_id, valid_until - greatest(valid_from, {WINDOW_START}) AS room FROM a2),
ctl AS (SELECT evidence_id AS query_id, entity, source, new_id, valid_until - least({DAY}, CAST(floor(room * 0.5) AS BIGINT)) AS query_time FROM old WHERE valid_until IS NOT NULL AND room >= 2000000),
seen AS (SELECT c.query_id, c.source, c.new_id, c.query_time, e.evidence_id, e.valid_from, CASE WHEN e.source = c.source AND (e.valid_until IS NULL OR c.query_time < e.valid_until) THEN 'TARGET_CURRENT' WHEN e.source = c.source THEN 'TARGET_OUTDATED' ELSE 'OTHER' END AS class FROM ctl c JOIN a2 e ON c.entity = e.entity AND e.valid_from <= c.query_time),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_TIE}) AS rank FROM seen) WHERE rank <= 50),
per AS (SELECT query_id, source, count(*) AS n, count(*) FILTER (WHERE valid_from > query_time) AS late, max((evidence_id = new_id)::INT) AS replacing, max((class = 'TARGET_CURRENT')::INT) AS cur, max((class = 'TARGET_OUTDATED')::INT) AS outd, min(rank) FILTER (WHERE class = 'TARGET_CURRENT' AND rank <= 10) AS first, count(*) FILTER (WHERE class = 'TARGET_OUTDATED' AND rank <= 10) AS stale FROM lst GROUP BY 1, 2)"""


@query(f"WITH {_CONTROL} SELECT source, count(*) AS queries, CAST(sum(late) AS BIGINT) AS visibility_violations, CAST(sum(replacing) AS BIGINT) AS replacing_in_pool, CAST(sum(cur) AS BIGINT) AS current_in_pool, CAST(sum(outd) AS BIGINT) AS outdated_in_pool, round(avg(n), 6) AS candidates, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(stale / 10.0::DOUBLE), 6) AS stale, round(avg(coalesce(first = 1, false)::INT), 6) AS top1_current FROM per GROUP BY 1")
def control_report(spark, sf):
    """Questions of a day before each replacement, by source: their pools are those of that day."""
    rows = A.intervals(spark, sf)
    ended = rows.where(F.col("valid_until").isNotNull()).withColumn("w", times.offset_before(F.col("valid_until"), F.col("valid_from"), F.lit(WINDOW_START), days=1)).where(F.col("w.at").isNotNull())
    after = rows.select("entity", "source", (F.col("seq") - 1).alias("seq"), F.col("evidence_id").alias("new_evidence_id"))
    controls = ended.select(F.col("evidence_id").alias("query_id"), "entity", "source", "seq", F.col("w.at").alias("query_time")).join(after, ["entity", "source", "seq"]).drop("seq")
    e = rows.select("entity", F.col("source").alias("e_source"), "evidence_id", "valid_from", "valid_until")
    seen = pit.asof_join(controls, e, ["entity"], "query_time", "valid_from")
    on, active = F.col("source") == F.col("e_source"), pit.active(F.col("valid_from"), F.col("valid_until"), F.col("query_time"))
    lists = ranking.top_k(seen.withColumn("class", F.when(on & active, "TARGET_CURRENT").when(on, "TARGET_OUTDATED").otherwise("OTHER")), 50, [text.tie_key(Retrieval.tie_seed, F.col("query_id"), F.col("evidence_id")).asc()])
    return control_checks(lists.select("query_id", "evidence_id", "rank", "class", F.col("valid_from").alias("observed_from")), controls.select("query_id", "query_time", "new_evidence_id", "source"), ["source"])
