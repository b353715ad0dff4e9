"""The driver's tables as assertions, intervals, queries, pools, documents and vectors, each with the same view in SQL.

Instants are microseconds. The observation window ends at WINDOW_END.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.config import DAY, Retrieval
from palimpsest.functions import text, times
from palimpsest.operators import pit, timeline

WINDOW_START, WINDOW_END = 1_704_067_200_000_000, 1_706_659_200_000_000  # 2024-01-01 and 2024-01-31
SEED = Retrieval.tie_seed
CHAIN = ["entity", "source"]
#: What tells the lists of questions apart and how they are dealt, see ``pit.asof_cells``; and chains that are dealt so.
LIST = ["entity", "cell", "query_id"]
DEALT = ["entity", "cell", "source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity, source, value, t: what each user's events of one type assert."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("event_type").alias("source"), (k % 4).alias("value"), times.micros(F.col("ts")).alias("t"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of the assertions, with evidence_id."""
    rows = timeline.value_intervals(assertions(spark, sf_dir), CHAIN, "t", "id", "value").drop("t")
    return rows.withColumn("evidence_id", F.concat_ws("|", "entity", "source", "seq"))


def dealt_intervals(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """``intervals`` with cell: assertions are dealt by entity and cell, and their chains (DEALT) lie there, see ``pit.deal``.

    ``only``: a condition on the entity that holds before they are dealt, into as many tasks as all of them, which so have fewer candidates each.
    """
    plain = assertions(spark, sf_dir) if only is None else assertions(spark, sf_dir).where(only)
    rows = timeline.value_intervals(pit.deal(plain, ["entity"], _pairs(spark, sf_dir)), DEALT, "t", "id", "value").drop("t")
    return rows.withColumn("evidence_id", F.concat_ws("|", "entity", "source", "seq"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity and __pairs, at least its questions times the intervals that they see."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg((F.count("*") * F.count("*")).alias("__pairs"))


def questions(rows: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """query_id, entity, source, query_time: one question after every replacement; old_id and new_id are the evidence around it."""
    order = Window.partitionBy(*chain).orderBy("seq")
    pairs = rows.select(*chain, "seq", F.col("evidence_id").alias("old_id"), F.lead("evidence_id").over(order).alias("new_id"), F.lead("valid_from").over(order).alias("event"), F.lead("valid_until").over(order).alias("ends"))
    asked = pairs.where(F.col("new_id").isNotNull()).withColumn("w", times.offset_after(F.col("event"), F.col("ends"), F.lit(WINDOW_END), days=1))
    kept = asked.where(F.col("w.at").isNotNull())
    return kept.select(text.query_id(F.col("entity"), F.col("source"), F.col("seq")).alias("query_id"), *chain, F.col("w.at").alias("query_time"), "old_id", "new_id")


def candidates(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """Every visible interval of a question's entity, with label, relation and class, dealt by entity and cell.

    ``rows``: the intervals, with more columns. If they come of ``dealt_intervals`` nothing is shuffled but the assertions, once. ``only`` is that of these: put on
    the candidates instead, a condition on the entity may reach one side of their join alone, which then has a shuffle of its own.
    """
    rows = dealt_intervals(spark, sf_dir, only) if rows is None else rows
    dealt = "cell" in rows.columns
    plain = dealt_intervals(spark, sf_dir, only) if dealt else intervals(spark, sf_dir)
    added = [c for c in rows.columns if c not in plain.columns]
    e = rows.select("entity", *["cell"] * dealt, F.col("source").alias("e_source"), "evidence_id", "value", "seq", "valid_from", "valid_until", F.col("replaced_by"), F.col("id").alias("assertion"), *added)
    if dealt:
        seen = pit.asof_within(questions(plain, DEALT), e, ["entity"], "query_time", "valid_from")
    else:
        seen = pit.asof_cells(questions(plain), e, ["entity"], "query_time", "valid_from", _pairs(spark, sf_dir))
    on = pit.target_chain(F.col("entity"), F.col("source"), F.lit(None).cast("string"), F.col("entity"), F.col("e_source"), F.lit(None).cast("string"))
    active = pit.active(F.col("valid_from"), F.col("valid_until"), F.col("query_time"))
    none = F.lit(False)
    labelled = seen.withColumns({"on_target": on, "label": pit.label(F.lit(True), none, on, active, F.lit(True)), "relation": pit.relation(F.lit(True), on, active, none)})
    return labelled.withColumn("class", pit.candidate_class(F.col("label"), F.col("relation")))


def pool(spark: SparkSession, sf_dir: str, size: int = 50, found: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """Candidates in the order of their hash, the first ``size`` of each question; score is 1 / rank. ``found``: the candidates, with more columns."""
    order = Window.partitionBy(*LIST).orderBy(text.tie_key(SEED, F.col("query_id"), F.col("evidence_id")))
    ranked = (candidates(spark, sf_dir, only=only) if found is None else found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranked.withColumns({"score": 1.0 / F.col("rank"), "method": F.lit("pool"), "age": times.age_days(F.col("query_time"), F.col("valid_from"))})


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions as additions and removals within changes of one user and hour."""
    a = assertions(spark, sf_dir)
    return a.select("*", F.when(F.col("id") % 3 == 0, "Removed").otherwise("Added").alias("action"), F.concat_ws("-", "entity", F.floor(F.col("t") / 3_600_000_000)).alias("change_id"))


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions as events of metric vectors, for the full replay."""
    letter = F.substring(F.lit("NALP"), (F.col("value") + 1).cast("int"), F.lit(1))
    vector = F.concat(F.lit("AV:"), letter, F.lit("/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"))
    return actions(spark, sf_dir).select(
        F.concat("change_id", F.lit("#"), "id").alias("event_id"), "change_id", F.lit(0).alias("change_pos"), F.col("entity").cast("string").alias("cve_id"), F.lit("CVE Modified").alias("event_name"), F.col("t").alias("created_at"), "action",
        F.lit("CVSS V3.1").alias("detail_type"), F.lit("3.1").alias("cvss_version"), F.col("source").alias("source_identifier_raw"), F.col("source").alias("source_key"), vector.alias("vector"), F.concat(F.lit("CVSS:3.1/"), vector).alias("vector_normalized"),
        F.concat(F.lit("NIST CVSS:3.1/"), vector).alias("vector_raw"), F.lit("NIST").alias("source_prefix"), F.lit("events").alias("source_file"), F.col("id").cast("int").alias("detail_index"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("*", (F.lit(WINDOW_START) + F.col("doc_id") * 3_600_000_000).alias("observed_from"), F.col("doc_id").cast("string").alias("evidence_id"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), "text", (F.lit(WINDOW_START) + (F.col("item_id") + 1) * DAY).alias("query_time"))


#: Alphabets of the metrics from which the parts' vectors are made.
METRICS = {
    "3.1": (("AV", "NALP"), ("AC", "LH"), ("PR", "NLH"), ("UI", "NR"), ("S", "UC"), ("C", "HLN"), ("I", "HLN"), ("A", "HLN")),
    "2.0": (("AV", "LAN"), ("AC", "HML"), ("Au", "MSN"), ("C", "NPC"), ("I", "NPC"), ("A", "NPC")),
    "4.0": (("AV", "NALP"), ("AC", "LH"), ("AT", "NP"), ("PR", "NLH"), ("UI", "NPA"), ("VC", "HLN"), ("VI", "HLN"), ("VA", "HLN"), ("SC", "HLN"), ("SI", "HLN"), ("SA", "HLN")),
}


def vectors(spark: SparkSession, sf_dir: str, version: str = "3.1", factor: int = 1) -> DataFrame:
    """p_partkey and a vector whose metrics are the digits of the key (times a factor) in mixed bases."""
    key, div, parts = F.col("p_partkey") * factor, 1, []
    for name, letters in METRICS[version]:
        parts.append(F.concat(F.lit(f"{name}:"), F.substring(F.lit(letters), (F.floor(key / div) % len(letters) + 1).cast("int"), F.lit(1))))
        div *= len(letters)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", *parts).alias("vector"))


def vector_sql(version: str = "3.1", factor: int = 1, key: str = "p_partkey") -> str:
    div, parts = 1, []
    for name, letters in METRICS[version]:
        parts.append(f"'{name}:' || substr('{letters}', 1 + (({key} * {factor}) // {div}) % {len(letters)}, 1)")
        div *= len(letters)
    return " || '/' || ".join(parts)


A1 = "a1 AS (SELECT event_id AS id, user_id AS entity, event_type AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS value, epoch_us(ts) AS t FROM events)"
A2 = A1 + """,
a2k AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY entity, source ORDER BY t, id) AS prev FROM a1) WHERE prev IS NULL OR prev <> value),
a2 AS (SELECT id, entity, source, value, row_number() OVER w AS seq, t AS valid_from, lead(t) OVER w AS valid_until, lead(id) OVER w AS replaced_by, lag(id) OVER w AS replaces,
       row_number() OVER (PARTITION BY entity, source, value ORDER BY t, id) > 1 AS reversal, entity || '|' || source || '|' || (row_number() OVER w) AS evidence_id
       FROM a2k WINDOW w AS (PARTITION BY entity, source ORDER BY t, id))"""
A4 = A2 + f""",
a4p AS (SELECT entity, source, seq, evidence_id AS old_id, lead(evidence_id) OVER w AS new_id, lead(valid_from) OVER w AS event, lead(valid_until) OVER w AS ends FROM a2 WINDOW w AS (PARTITION BY entity, source ORDER BY seq)),
a4r AS (SELECT *, least(coalesce(ends, {WINDOW_END}), {WINDOW_END}) - event AS remaining FROM a4p WHERE new_id IS NOT NULL),
a4 AS (SELECT 'q_' || substr(sha1(entity || '|' || source || '|' || seq), 1, 16) AS query_id, entity, source, event + least({DAY}, CAST(floor(remaining * 0.5) AS BIGINT)) AS query_time, old_id, new_id FROM a4r WHERE remaining >= 2000000)"""
CAND = A4 + """,
cand AS (SELECT q.query_id, q.entity, q.source, q.query_time, q.old_id, q.new_id, e.source AS e_source, e.evidence_id, e.value, e.seq, e.valid_from, e.valid_until, e.replaced_by, e.id AS assertion, e.source = q.source AS on_target,
         (e.valid_until IS NULL OR q.query_time < e.valid_until) AS is_active FROM a4 q JOIN a2 e ON q.entity = e.entity AND e.valid_from <= q.query_time),
candl AS (SELECT *, CASE WHEN NOT on_target THEN 'NOT_TARGET_CHAIN' WHEN is_active THEN 'CURRENT' ELSE 'OUTDATED' END AS label,
          CASE WHEN on_target THEN 'TARGET_SOURCE' WHEN is_active THEN 'OTHER_SOURCE_CURRENT' ELSE 'OTHER_SOURCE_INACTIVE' END AS relation,
          CASE WHEN on_target AND is_active THEN 'TARGET_CURRENT' WHEN NOT on_target AND is_active THEN 'OTHER_SOURCE_CURRENT' WHEN on_target THEN 'TARGET_OUTDATED' ELSE 'OTHER' END AS class FROM cand)"""
POOL = CAND + f""",
pool AS (SELECT *, 1.0::DOUBLE / rank AS score, (query_time - valid_from) / {DAY}.0::DOUBLE AS age FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('{SEED}|' || query_id || '|' || evidence_id)) AS rank FROM candl) WHERE rank <= 50)"""
A3 = A1 + ", a3 AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'Removed' ELSE 'Added' END AS action, entity || '-' || (t // 3600000000) AS change_id FROM a1)"
A5 = f"a5 AS (SELECT *, {WINDOW_START} + doc_id * 3600000000 AS observed_from, CAST(doc_id AS VARCHAR) AS evidence_id FROM documents)"
A6 = f"a6 AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, {WINDOW_START} + (item_id + 1) * {DAY} AS query_time FROM benchmark)"
