"""Timelines and points in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import times
from palimpsest.operators import pit, timeline
from palimpsest.plans.catalogue import query
from palimpsest.sources import adapters as A
from palimpsest.sources.adapters import A2, A3, A4, CAND, CHAIN, WINDOW_END, WINDOW_START


@query(f"WITH {A2} SELECT entity, source, seq, value, valid_from, coalesce(valid_until, -1) AS valid_until, coalesce(replaced_by, -1) AS replaced_by, coalesce(replaces, -1) AS replaces FROM a2")
def timeline_intervals(spark, sf):
    or_none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return A.intervals(spark, sf).select(*CHAIN, "seq", "value", "valid_from", or_none("valid_until"), or_none("replaced_by"), or_none("replaces"))


@query(f"WITH {A3} SELECT entity, source, id, value, t FROM (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY t, id) AS n FROM a3) WHERE n = 1 AND action = 'Removed'")
def timeline_left_censored(spark, sf):
    return timeline.left_censored(A.actions(spark, sf), CHAIN, ["t", "id"]).select(*CHAIN, "id", "value", "t")


@query(f"WITH {A2} SELECT source, count(*) FILTER (WHERE reversal) AS reversals, count(*) AS intervals FROM a2 GROUP BY 1")
def timeline_reversals(spark, sf):
    return A.intervals(spark, sf).groupBy("source").agg(F.count_if("reversal").alias("reversals"), F.count("*").alias("intervals"))


@query(f"WITH {A2} SELECT source, count(*) AS duplicates FROM (SELECT *, lag(value) OVER (PARTITION BY entity, source ORDER BY t, id) AS prev FROM a1) WHERE prev = value GROUP BY 1")
def timeline_duplicates_dropped(spark, sf):
    before = F.lag("value").over(Window.partitionBy(*CHAIN).orderBy("t", "id"))
    return A.assertions(spark, sf).withColumn("prev", before).where(F.col("prev") == F.col("value")).groupBy("source").agg(F.count("*").alias("duplicates"))


@query(f"WITH {A2}, d AS (SELECT unnest([5, 10, 15, 20, 25])::BIGINT AS day) SELECT day, source, count(*) AS active, CAST(sum(value) AS BIGINT) AS total FROM a2, d WHERE valid_from <= {WINDOW_START} + day * 86400000000 AND (valid_until IS NULL OR {WINDOW_START} + day * 86400000000 < valid_until) GROUP BY 1, 2")
def snapshot_as_of(spark, sf):
    rows = A.intervals(spark, sf).withColumn("day", F.explode(F.array(*[F.lit(d) for d in (5, 10, 15, 20, 25)])))
    at = F.lit(WINDOW_START) + F.col("day").cast("long") * 86_400_000_000
    return pit.snapshot(rows, at).groupBy("day", "source").agg(F.count("*").alias("active"), F.sum("value").alias("total"))


@query(f"WITH {A4}, m AS (SELECT valid_from AS t, 0 AS side, NULL AS query_id FROM a2 UNION ALL SELECT query_time, 1, query_id FROM a4) SELECT query_id, n AS visible_count FROM (SELECT *, count(*) FILTER (WHERE side = 0) OVER (ORDER BY t, side RANGE UNBOUNDED PRECEDING) AS n FROM m) WHERE side = 1".replace("ORDER BY t, side RANGE UNBOUNDED PRECEDING", "ORDER BY t, side ROWS UNBOUNDED PRECEDING"))
def asof_visible_count(spark, sf):
    rows = A.intervals(spark, sf)
    return pit.asof_count(A.questions(rows), rows, "query_id", "query_time", "valid_from")


@query(f"WITH {CAND} SELECT label, relation, class, count(*) AS n FROM candl GROUP BY ALL")
def pit_label_counts(spark, sf):
    return A.candidates(spark, sf).groupBy("label", "relation", "class").agg(F.count("*").alias("n"))


@query(f"WITH {CAND} SELECT query_id, query_time, min(evidence_id) FILTER (WHERE label = 'CURRENT') AS answer, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE label = 'CURRENT'), '') AS current_ids, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE label = 'OUTDATED'), '') AS outdated_ids, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE relation = 'OTHER_SOURCE_CURRENT'), '') AS other_ids, count(*) AS visible FROM candl GROUP BY 1, 2")
def pit_query_generation(spark, sf):
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("evidence_id"))))
    g = A.candidates(spark, sf).groupBy("query_id", "query_time").agg(ids(F.col("label") == "CURRENT").alias("c"), ids(F.col("label") == "OUTDATED").alias("o"), ids(F.col("relation") == "OTHER_SOURCE_CURRENT").alias("x"), F.count("*").alias("visible"))
    return g.select("query_id", "query_time", F.try_element_at("c", F.lit(1)).alias("answer"), F.array_join("c", ",").alias("current_ids"), F.array_join("o", ",").alias("outdated_ids"), F.array_join("x", ",").alias("other_ids"), "visible")


_OFFSET = 30 * 86_400_000_000
_ASKED = f"""{A2}, prs AS (SELECT entity, source, evidence_id AS old_id, valid_from AS o_from, valid_until AS o_until, replaced_by, lead(evidence_id) OVER w AS new_id, lead(valid_from) OVER w AS n_from, lead(valid_until) OVER w AS n_until FROM a2 WINDOW w AS (PARTITION BY entity, source ORDER BY seq)),
tmd AS (SELECT *, 'POST_REPLACEMENT_MAIN' AS role, least(coalesce(n_until, {WINDOW_END}), {WINDOW_END}) - n_from AS room FROM prs WHERE new_id IS NOT NULL UNION ALL SELECT *, 'PRE_REPLACEMENT_CONTROL', o_until - greatest(o_from, {WINDOW_START}) FROM prs WHERE new_id IS NOT NULL),
ask AS (SELECT * FROM (SELECT *, CASE WHEN role = 'POST_REPLACEMENT_MAIN' THEN n_from + least({_OFFSET}, CAST(floor(room * 0.5) AS BIGINT)) ELSE o_until - least({_OFFSET}, CAST(floor(room * 0.5) AS BIGINT)) END AS at_time FROM tmd WHERE room >= 2000000) WHERE at_time BETWEEN {WINDOW_START} AND {WINDOW_END}),
cnd AS (SELECT a.old_id, a.role, e.evidence_id, e.source = a.source AS mine, e.valid_until IS NULL OR a.at_time < e.valid_until AS active FROM ask a JOIN a2 e ON e.entity = a.entity AND e.valid_from <= a.at_time),
gld AS (SELECT old_id, role, min(evidence_id) FILTER (WHERE mine AND active) AS answer, count(*) FILTER (WHERE mine AND active) AS n_current, count(*) FILTER (WHERE mine AND NOT active) AS n_outdated, count(*) FILTER (WHERE NOT mine AND active) AS n_other, count(*) AS n_visible FROM cnd GROUP BY 1, 2),
tot AS (SELECT valid_from AS t, max(n) AS n FROM (SELECT valid_from, count(*) OVER (ORDER BY valid_from) AS n FROM a2) GROUP BY 1)"""


@query(f"WITH {_ASKED} SELECT 'q_' || substr(sha1('train|e' || a.replaced_by || '|' || a.old_id || '|' || a.role || '|base_severity'), 1, 16) AS query_id, a.role AS query_role, a.at_time AS query_time, g.answer AS answer_evidence_id, n_current, n_outdated, n_other, n_visible, CAST(tot.n AS BIGINT) AS visible_corpus_count FROM ask a JOIN gld g USING (old_id, role) ASOF JOIN tot ON a.at_time >= tot.t WHERE g.answer IS NOT NULL AND (a.role <> 'POST_REPLACEMENT_MAIN' OR n_outdated > 0)")
def generated_queries(spark, sf):
    """Questions after and before every replacement, by the library's generator."""
    rows = A.intervals(spark, sf)
    order = Window.partitionBy(*CHAIN).orderBy("seq")
    named = rows.select(F.col("entity").cast("string").alias("cve_id"), F.col("source").alias("source_key"), F.lit("3.1").alias("cvss_version"), "evidence_id", "valid_from", "valid_until", "replaced_by", F.lead("evidence_id").over(order).alias("next_id"))
    events = named.where(F.col("next_id").isNotNull()).select(F.lit("train").alias("split"), F.concat(F.lit("e"), "replaced_by").alias("termination_event_id"), "cve_id", "cvss_version", "source_key", F.col("evidence_id").alias("old_evidence_id"), F.col("next_id").alias("new_evidence_id"))
    given = {"base_vector": F.lit("AV:N"), "base_score": F.lit(5.0), "base_severity": F.lit("MEDIUM"), "valid_from_censored": F.lit(False), "chain_ambiguous": F.lit(False)}
    evidence = named.withColumns({"observed_from": F.col("valid_from"), "replacement_type": F.when(F.col("valid_until").isNotNull(), "STRICT_SAME_CHANGE"), **given}).drop("replaced_by", "next_id")
    made, _ = pit.generate_queries(events, evidence, events.select("old_evidence_id", F.lit("base_severity").alias("query_template_id")), (WINDOW_START, WINDOW_END))
    sizes = {"n_current": "current_evidence_ids", "n_outdated": "outdated_evidence_ids", "n_other": "other_source_current_evidence_ids", "n_visible": "visible_evidence_ids"}
    return made.select("query_id", "query_role", "query_time", "answer_evidence_id", *[F.size(c).alias(name) for name, c in sizes.items()], "visible_corpus_count")


@query(f"WITH {A2}, r AS (SELECT *, valid_until - greatest(valid_from, {WINDOW_START}) AS room FROM a2 WHERE valid_until IS NOT NULL) SELECT evidence_id, CASE WHEN room >= 2000000 THEN valid_until - least(86400000000, CAST(floor(room * 0.5) AS BIGINT)) END AS query_time, CASE WHEN room < 2000000 THEN 'OLD_INTERVAL_TOO_SHORT' END AS reason FROM r")
def pit_query_pre_control(spark, sf):
    w = times.offset_before(F.col("valid_until"), F.col("valid_from"), F.lit(WINDOW_START), days=1)
    return A.intervals(spark, sf).where(F.col("valid_until").isNotNull()).select("evidence_id", w.alias("w")).select("evidence_id", F.col("w.at").alias("query_time"), F.col("w.reason").alias("reason"))


_WITNESS = f"WITH {CAND}, wit AS (SELECT c.query_id, c.evidence_id, min_by(w.evidence_id, (w.valid_from, w.evidence_id)) AS witness FROM candl c JOIN a2 w ON w.entity = c.entity AND w.source = c.e_source AND w.valid_from > c.valid_from AND w.valid_from <= c.query_time AND w.value <> c.value GROUP BY 1, 2)"


def _chained(spark, sf):
    rows = A.intervals(spark, sf)
    c = A.candidates(spark, sf).select("query_id", "entity", F.col("e_source").alias("source"), "evidence_id", "value", "valid_from", "query_time", "class", "replaced_by")
    return c, rows


@query(f"{_WITNESS} SELECT class, count(*) AS n, count(witness) AS superseded FROM candl LEFT JOIN wit USING (query_id, evidence_id) GROUP BY 1")
def supersession_exists(spark, sf):
    c, rows = _chained(spark, sf)
    found = pit.superseded_semi(c, rows, CHAIN, "valid_from", "value", "query_time")
    return c.groupBy("class").agg(F.count("*").alias("n")).join(found.groupBy("class").agg(F.count("*").alias("superseded")), "class", "left").select("class", "n", F.coalesce("superseded", F.lit(0)).alias("superseded"))


@query(f"{_WITNESS} SELECT query_id, evidence_id, witness FROM wit")
def supersession_first_witness(spark, sf):
    c, rows = _chained(spark, sf)
    return pit.first_witness(c, rows, CHAIN, "valid_from", "evidence_id", "value", "query_time", ["query_id", "evidence_id"]).where("superseded").select("query_id", "evidence_id", "witness")


@query(f"WITH {CAND} SELECT c.class, count(*) FILTER (WHERE s.valid_from <= c.query_time) AS linked, count(*) AS n FROM candl c LEFT JOIN a2 s ON c.replaced_by = s.id GROUP BY 1")
def direct_link_flag(spark, sf):
    c, rows = _chained(spark, sf)
    return pit.direct_link(c, rows, F.col("replaced_by"), "id", "valid_from", "query_time").groupBy("class").agg(F.count_if("direct").alias("linked"), F.count("*").alias("n"))


@query(f"WITH {A2} SELECT o.evidence_id AS old_evidence_id, n.evidence_id AS new_evidence_id, n.valid_from AS event_time, o.value AS old_value, n.value AS new_value FROM a2 o JOIN a2 n ON o.replaced_by = n.id")
def replacement_events_selfjoin(spark, sf):
    rows = A.intervals(spark, sf)
    o, n = rows.alias("o"), rows.alias("n")
    return o.join(n, F.col("o.replaced_by") == F.col("n.id")).select(F.col("o.evidence_id").alias("old_evidence_id"), F.col("n.evidence_id").alias("new_evidence_id"), F.col("n.valid_from").alias("event_time"), F.col("o.value").alias("old_value"), F.col("n.value").alias("new_value"))


@query(f"WITH {A4} SELECT evidence_id, CASE WHEN evidence_id IN (SELECT old_id FROM a4) THEN 'replaced_old' WHEN evidence_id IN (SELECT new_id FROM a4) THEN 'replacing_new' ELSE 'chain_context' END AS evidence_role FROM a2")
def role_tagging(spark, sf):
    rows = A.intervals(spark, sf)
    q = A.questions(rows)
    return pit.roles(rows.select("evidence_id"), q.select(F.col("old_id").alias("evidence_id")), q.select(F.col("new_id").alias("evidence_id")), "evidence_id")


@query(f"WITH {A2}, d AS (SELECT evidence_id, valid_from, valid_until, unnest([1, 5, 10])::BIGINT AS days FROM a2), e AS (SELECT *, valid_from + days * 86400000000 AS at0 FROM d) SELECT evidence_id, days, CASE WHEN at0 >= valid_until THEN 'CURRENT_INTERVAL_ENDS_BEFORE_OFFSET' WHEN at0 > {WINDOW_END} THEN 'BEYOND_OBSERVATION_WINDOW' ELSE 'KEPT' END AS outcome, CASE WHEN at0 <= {WINDOW_END} AND (valid_until IS NULL OR at0 < valid_until) THEN at0 ELSE -1 END AS query_time FROM e")
def offset_exclusions(spark, sf):
    rows = A.intervals(spark, sf).select("evidence_id", "valid_from", "valid_until", F.explode(F.array(*[F.lit(d).cast("long") for d in (1, 5, 10)])).alias("days"))
    w = rows.withColumn("w", times.retime(F.col("valid_from"), F.col("valid_until"), F.lit(WINDOW_END), F.col("days")))
    return w.select("evidence_id", "days", F.coalesce("w.reason", F.lit("KEPT")).alias("outcome"), F.coalesce("w.at", F.lit(-1)).alias("query_time"))


@query(f"WITH {A4} SELECT query_id, round((query_time - valid_from) / 86400000000.0, 6) AS age FROM a4 JOIN a2 ON old_id = evidence_id", digits=6)
def age_days(spark, sf):
    rows = A.intervals(spark, sf)
    q = A.questions(rows).join(rows.select(F.col("evidence_id").alias("old_id"), "valid_from"), "old_id")
    return q.select("query_id", times.age_days(F.col("query_time"), F.col("valid_from")).alias("age"))


@query(f"WITH {A4}, e AS (SELECT DISTINCT entity FROM a4), s AS (SELECT entity FROM e ORDER BY md5('20260917|' || entity) LIMIT 20) SELECT entity, min(query_id) AS query_id FROM a4 WHERE entity IN (SELECT entity FROM s) GROUP BY 1")
def entity_sample(spark, sf):
    q = A.questions(A.intervals(spark, sf))
    chosen = q.select("entity").distinct().orderBy(F.md5(F.concat(F.lit("20260917|"), F.col("entity")).cast("binary"))).limit(20)
    return q.join(F.broadcast(chosen), "entity", "left_semi").groupBy("entity").agg(F.min("query_id").alias("query_id"))


_PAIR = A3 + ", pr AS (SELECT change_id, source, count(*) FILTER (WHERE action = 'Removed') AS r, count(*) FILTER (WHERE action = 'Added') AS a, max(value) FILTER (WHERE action = 'Removed') AS ov, max(value) FILTER (WHERE action = 'Added') AS nv, min(id) AS first_id FROM a3 GROUP BY 1, 2 HAVING r > 0 AND a > 0)"


@query(f"WITH {_PAIR} SELECT CASE WHEN r = 1 AND a = 1 AND ov <> nv AND first_id % 5 IN (0, 1, 2) THEN 'STRICT' WHEN r <> 1 OR a <> 1 OR ov = nv OR first_id % 5 = 3 THEN 'EXCLUDED' ELSE 'MODERATE' END AS tier, count(*) AS n FROM pr GROUP BY 1")
def pair_classify_tiers(spark, sf):
    c = lambda x: F.count_if(F.col("action") == x)
    v = lambda x: F.max(F.when(F.col("action") == x, F.col("value")))
    pairs = A.actions(spark, sf).groupBy("change_id", "source").agg(c("Removed").alias("r"), c("Added").alias("a"), v("Removed").alias("ov"), v("Added").alias("nv"), F.min("id").alias("first_id")).where("r > 0 AND a > 0")
    letter = lambda x: F.substring(F.lit("NALP"), (F.col(x) + 1).cast("int"), F.lit(1))
    vec = lambda x: F.concat(F.lit("CVSS:3.1/AV:"), letter(x), F.lit("/AC:L"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("CVE Modified", "Modified Analysis", "Reanalysis", "Data Remediation", "Other Event")]), (F.col("first_id") % 5 + 1).cast("int"))
    judged = timeline.classify_pair(names, F.lit("CVSS V3.1"), F.lit("NIST"), F.lit(" nist"), vec("ov"), vec("nv"), F.col("r"), F.col("a"))
    return pairs.select(judged.alias("c")).groupBy("c.tier").agg(F.count("*").alias("n"))


@query(f"WITH {A2} SELECT CAST(entity AS VARCHAR) AS entity, source, seq, value, valid_from, valid_until FROM a2 WHERE valid_until IS NOT NULL")
def event_chain_stream(spark, sf):
    import uuid

    from palimpsest.streaming.chains import replay_files

    base = (spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/palimpsest-{uuid.uuid4().hex}") + f"/stream-{uuid.uuid4().hex}"
    return replay_files(spark, sf, f"{base}/out", f"{base}/checkpoint").where("status = 'CLOSED'").drop("status")
