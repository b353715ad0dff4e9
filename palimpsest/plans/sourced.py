"""Sources: change pages and entity pages made from the tables, written as files and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scores, vectors
from palimpsest.operators import corpus
from palimpsest.plans.catalogue import query
from palimpsest.plans.scalar import _UP31, _v3_sql
from palimpsest.session import shared_dir
from palimpsest.sources import adapters as A
from palimpsest.sources import changelog, files
from palimpsest.sources.adapters import A3, table, vector_sql

#: What is wrong with a change, by its least event id modulo FAULTS; the others are well formed.
FAULTS, MISSING, NULL, TEXT, EMPTY, NUMBER, BARE, TIME = 17, 0, 1, 2, 3, 4, 5, 6
#: Pages that are no history: broken, no object, changes that are no list.
BROKEN = ("{", "[]", '{"cveChanges": {}}')
#: Pages of changes there are at least, and the changes that one has at most or so: their number grows with the table, not their size.
PAGES, PAGE_CHANGES = 50, 5_000


def change_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: pages of changes with their actions as details, and the three broken ones. No page or task holds more than a bounded part of an entity's changes."""
    a = A.actions(spark, sf_dir)
    n = max(PAGES, -(-table(spark, sf_dir, "events").count() // PAGE_CHANGES))  # a change has an event at least
    value = F.concat(F.lit("v"), "value")
    detail = F.struct("t", "id", F.to_json(F.struct("action", F.lit("CVSS V3.1").alias("type"), F.when(F.col("action") == "Removed", value).alias("oldValue"), F.when(F.col("action") == "Added", value).alias("newValue"))).alias("json"))
    change = a.groupBy("change_id", "entity").agg(F.min("id").alias("c"), F.min("t").alias("t0"), F.min("source").alias("src"), F.array_join(F.transform(F.array_sort(F.collect_list(detail)), lambda x: x["json"]), ",").alias("details"))
    fault = F.col("c") % FAULTS
    details = (
        F.when(fault == MISSING, "").when(fault == NULL, ',"details":null').when(fault == TEXT, ',"details":"none"').when(fault == EMPTY, ',"details":[]')
        .when(fault == NUMBER, F.concat(F.lit(',"details":[5,'), "details", F.lit("]"))).otherwise(F.concat(F.lit(',"details":['), "details", F.lit("]")))
    )
    created = F.when(fault == TIME, "some day").otherwise(F.date_format(F.timestamp_micros("t0"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    head = F.to_json(F.struct(F.col("entity").cast("string").alias("cveId"), F.lit("CVE Modified").alias("eventName"), F.col("change_id").alias("cveChangeId"), F.col("src").alias("sourceIdentifier"), created.alias("created")))
    one = F.when(fault == BARE, '{"change":"x"}').otherwise(F.concat(F.lit('{"change":'), F.regexp_replace(head, r"\}$", ""), details, F.lit("}}")))
    pages = change.groupBy(F.pmod(F.xxhash64("change_id"), F.lit(n)).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("changes"))
    whole = pages.select(F.concat(F.lit('{"cveChanges":['), "changes", F.lit("]}")).alias("text"))
    return whole.unionByName(spark.createDataFrame([(x,) for x in BROKEN], "text string"))


def written(spark: SparkSession, pages: DataFrame, label: str) -> DataFrame:
    """Pages written as files, a page each, and read as such: source_file and text."""
    path = f"{shared_dir(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"
    pages.select("text").write.option("maxRecordsPerFile", 1).text(path)
    return changelog.read_texts(spark, path, "*.txt")


_CHANGES = f"""{A3}, chg AS (SELECT change_id, entity, min(id) AS c, min(t) AS t0, min(source) AS src FROM a3 GROUP BY 1, 2),
det AS (SELECT change_id, action, 'v' || value AS v, row_number() OVER (PARTITION BY change_id ORDER BY t, id) - 1 AS i FROM a3),
own AS (SELECT *, CAST(entity AS VARCHAR) AS cve_id, CASE WHEN c % {FAULTS} = {TIME} THEN -1 ELSE t0 END AS created_at FROM chg)"""


@query(f"WITH {_CHANGES} SELECT cve_id, change_id, src AS source_identifier, created_at, i + (c % {FAULTS} = {NUMBER})::INT AS detail_index, action, CASE WHEN action = 'Removed' THEN v ELSE '' END AS old_value, CASE WHEN action = 'Added' THEN v ELSE '' END AS new_value FROM own JOIN det USING (change_id) WHERE c % {FAULTS} NOT IN ({MISSING}, {NULL}, {TEXT}, {EMPTY}, {BARE}) UNION ALL SELECT cve_id, change_id, src, created_at, -1, '', '', '' FROM own WHERE c % {FAULTS} IN ({MISSING}, {NULL}, {EMPTY})")
def change_records(spark, sf):
    found = changelog.records(written(spark, change_pages(spark, sf), "pages"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select("cve_id", "change_id", "source_identifier", F.coalesce("created_at", F.lit(-1)).alias("created_at"), "detail_index", blank("action"), blank("old_value"), blank("new_value"))


@query(f"WITH {_CHANGES}, k AS (SELECT CASE c % {FAULTS} WHEN {BARE} THEN 'CHANGE_NOT_DICT' WHEN {TEXT} THEN 'DETAILS_NOT_LIST' WHEN {TIME} THEN 'CREATED_UNPARSEABLE' WHEN {NUMBER} THEN 'DETAIL_NOT_DICT' END AS kind FROM chg UNION ALL SELECT unnest(['PAGE_READ_ERROR', 'PAGE_READ_ERROR', 'CVE_CHANGES_NOT_LIST'])) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1")
def change_issues(spark, sf):
    return changelog.issues(written(spark, change_pages(spark, sf), "pages")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_CHANGES} SELECT coalesce(CASE c % {FAULTS} WHEN {MISSING} THEN 'DETAILS_KEY_MISSING' WHEN {NULL} THEN 'DETAILS_NULL' WHEN {TEXT} THEN 'DETAILS_NOT_LIST:str' WHEN {EMPTY} THEN 'DETAILS_EMPTY_LIST' END, 'NONE') AS class, count(*) AS n FROM chg WHERE c % {FAULTS} <> {BARE} GROUP BY 1")
def change_empty_details(spark, sf):
    found = changelog.empty_details(written(spark, change_pages(spark, sf), "pages"))
    return found.groupBy(F.coalesce("class", F.lit("NONE")).alias("class")).agg(F.count("*").alias("n"))


def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: entity pages with published scores of the parts' vectors: right ones, ones a tenth too high, and twice the same key (the last counts)."""
    p = A.vectors(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    base = scores.base_score_v3(vectors.components(F.col("vector")), "3.1")
    scored = p.withColumns({"base": base, "k": F.col("p_partkey") % 4})
    entry = lambda score: F.struct(F.lit("nvd").alias("source"), F.struct(F.concat(F.lit("CVSS:3.1/"), "vector").alias("vectorString"), score.alias("baseScore"), F.lit("HIGH").alias("baseSeverity")).alias("cvssData"))
    right, wrong = entry(F.col("base")), entry(F.round(F.col("base") + 0.1, 1))
    entries = F.when(F.col("k") == 0, F.array(right)).when(F.col("k") == 1, F.array(wrong)).when(F.col("k") == 2, F.array(wrong, right)).otherwise(F.array(entry(F.lit(None).cast("double"))))
    item = F.struct(F.struct(F.concat(F.lit("CVE-"), "p_partkey").alias("id"), F.struct(entries.alias("cvssMetricV31")).alias("metrics")).alias("cve"))
    pages = scored.groupBy((F.col("p_partkey") % 20).alias("page")).agg(F.collect_list(item).alias("vulnerabilities"))
    return pages.select(F.to_json(F.struct("vulnerabilities")).alias("text"))


@query(f"WITH s AS ({_v3_sql(_UP31)}), x AS (SELECT s.*, {vector_sql('3.1')} AS v FROM s) SELECT CASE WHEN p_partkey % 4 = 3 THEN 'NOT_AVAILABLE_IN_HISTORY' WHEN p_partkey % 4 = 1 THEN 'UNRESOLVED' ELSE 'CVSS-B' END AS reported_score_type, p_partkey % 4 IN (0, 2) AS reported_score_matches, count(*) AS n, round(sum(CASE p_partkey % 4 WHEN 3 THEN 0 WHEN 1 THEN round(score + 0.1, 1) ELSE score END), 4) AS total FROM x GROUP BY 1, 2", digits=4)
def published_scores_joined(spark, sf):
    published = changelog.reported_scores(written(spark, entity_pages(spark, sf), "entities"))
    rows = A.vectors(spark, sf).select(F.concat(F.lit("CVE-"), "p_partkey").alias("cve_id"), F.lit("nvd").alias("source_identifier_raw"), F.lit("3.1").alias("cvss_version"), "vector")
    told = corpus.with_published(rows, published)
    return told.groupBy("reported_score_type", "reported_score_matches").agg(F.count("*").alias("n"), F.coalesce(F.sum("reported_score"), F.lit(0.0)).alias("total"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jsonl_by_ids(spark, sf):
    """Documents written as JSON lines, a folder for each language, and read back by a set of ids."""
    path = f"{shared_dir(spark)}/palimpsest-jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, ["lang"])
    ids = table(spark, sf, "labels").where("quality = 1").select("doc_id").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    return files.read_by_ids(files.read_jsonl(spark, path, "doc_id long, n_chars long, lang string"), ids, "doc_id", ["lang", "n_chars"])


#: What is wrong with a document as a corpus row, by its id modulo 11: the column that is spoiled, how, and the reason given.
_SPOILED = (
    ("cve_id", "''", "MISSING_CVE_ID"), ("source_key", "NULL", "MISSING_SOURCE_KEY"), ("cvss_version", "'[UNKNOWN]'", "MISSING_CVSS_VERSION"), ("base_vector", "'AV:*'", "BASE_VECTOR_NOT_PARSEABLE"), ("observed_from", "NULL", "MISSING_OBSERVED_FROM"),
    ("source_file", "''", "MISSING_PROVENANCE"), ("chain_ambiguous", "TRUE", "AMBIGUOUS_CHAIN"), ("evidence_text", "''", "TEXT_NOT_GENERATED"), ("evidence_text", "'It is the Current one'", "TEXT_CONTAINS_LABEL_WORD"), ("evidence_text", "'see ' || replaced_by_evidence_id", "TEXT_CONTAINS_FUTURE_INFO"),
)


@query("SELECT CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, _, reason) in enumerate(_SPOILED)) + " ELSE 'ACCEPTED' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def corpus_admission(spark, sf):
    """Corpus rows of which ten in eleven are spoiled, each in its own way, through the library's rule and its split."""
    fine = {"cve_id": "concat('C', doc_id)", "source_key": "source", "cvss_version": "'3.1'", "base_vector": "'AV:N/AC:L'", "observed_from": "doc_id", "source_file": "'f'", "chain_ambiguous": "FALSE", "evidence_text": "concat('assessed as ', doc_id, ';')", "replaced_by_evidence_id": "concat('e|', doc_id)"}
    rows = table(spark, sf, "documents").select("doc_id", *[F.expr(x).alias(c) for c, x in fine.items()])
    by_column: dict[str, str] = {}
    for i, (column, how, _) in enumerate(_SPOILED):
        by_column[column] = f"{by_column.get(column, 'CASE')} WHEN doc_id % 11 = {i} THEN {how}"
    spoiled = rows.select("doc_id", *[F.expr(f"{by_column[c]} ELSE {c} END").alias(c) if c in by_column else F.col(c) for c in fine])
    accepted, excluded = corpus.admit(spoiled, corpus.eligibility())
    told = accepted.select(F.lit("ACCEPTED").alias("reason")).unionByName(excluded.select("reason"))
    return told.groupBy("reason").agg(F.count("*").alias("n"))
