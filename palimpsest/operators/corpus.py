"""The document corpus: rendered rows and the rules that admit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import UNKNOWN, Queries
from palimpsest.functions import scores, text, times, vectors

#: What a reranker may see, and what it must not.
VIEW = ("evidence_id", "cve_id", "source_key", "cvss_version", "observed_from", "canonical_base_vector", "valid_from_censored")
FORBIDDEN = ("valid_until", "replacement_type", "replaced_by_evidence_id", "superseded_by_evidence_id", "timeline_status", "label", "relation", "class", "termination_event_id")


def documents(intervals: DataFrame, splits: DataFrame | None = None, lookup: Column | None = None) -> DataFrame:
    """Corpus rows of intervals: base vector, score, severity and the sentence that is retrieved.

    ``lookup``: the table for version 4.0 (see ``scores.score_v4``); ``splits``: (cve_id, split).
    """
    parts = intervals.withColumn("m", vectors.components(F.col("vector")))
    scored = parts.withColumns({"base_vector": vectors.base_vector(F.col("cvss_version"), F.col("m")), "base_score": scores.base_score(F.col("cvss_version"), F.col("m"), F.col("vector"), lookup)})
    scored = scored.withColumn("base_severity", scores.severity(F.col("cvss_version"), F.col("base_score")))
    threat = F.when(F.col("cvss_version") == "4.0", F.nullif(F.try_element_at("m", F.lit("E")), F.lit("X")))
    scored = scored.withColumns({"threat_metric_value": threat, "threat_metric_present": threat.isNotNull()})
    if lookup is not None:
        bt = F.when(threat.isNotNull() & scores.valid_v4(F.col("vector"), F.col("m")), scores.score_v4(scores.keep_groups_v4(F.col("m"), True), lookup))
        scored = scored.withColumn("bt_score", bt)
    else:
        scored = scored.withColumn("bt_score", F.lit(None).cast("double"))
    scored = scored.withColumn("bt_severity", scores.severity(F.col("cvss_version"), F.col("bt_score")))
    assigned = scored.join(splits, "cve_id", "left").withColumn("split", F.coalesce("split", F.lit("corpus_only"))) if splits is not None else scored.withColumn("split", F.lit("corpus_only"))
    date = F.coalesce(times.date_of(F.col("valid_from")), F.lit(""))
    sentence = text.evidence_text(date, F.col("source_key"), F.col("cve_id"), F.col("cvss_version"), F.col("base_vector"), F.col("base_score"), F.col("base_severity"), F.col("valid_from_censored"))
    replaced = F.col("superseded_by_evidence_id")
    return assigned.select(
        "evidence_id", "cve_id", "source_identifier_raw", "source_key", "cvss_version", F.col("vector_raw").alias("full_vector"), "base_vector", "base_score", "base_severity", F.lit("CVSS-B").alias("score_type"),
        "threat_metric_present", "threat_metric_value", "bt_score", "bt_severity", "valid_from", "valid_until", "valid_from_censored", "observed_from", "timeline_status", "activation_event_id", "termination_event_id",
        F.when(replaced.isNotNull(), F.col("termination_event_id")).alias("replacement_event_id"), "replacement_type", "replaces_evidence_id", replaced.alias("replaced_by_evidence_id"), "chain_id", "chain_ambiguous", "split", "source_file",
        sentence.alias("evidence_text"),
    )


def with_published(rows: DataFrame, published: DataFrame, lookup: Column | None = None) -> DataFrame:
    """Adds reported_score, reported_score_type and reported_score_matches: what the source published for this very vector, and how it
    relates to the computed scores.

    rows: cve_id, source_identifier_raw, cvss_version, vector; published: as of ``changelog.reported_scores``, one row a key. Without a
    published score the type says so; a null in any of the four keys finds none.
    """
    p = published.select(
        F.col("cve_id").alias("__cve"), F.col("source").alias("__source"), F.col("version").alias("__version"), F.col("vector").alias("__vector"),
        F.col("reported_score").alias("__score"), F.col("reported_severity").alias("__severity"),
    )
    version, vector = F.col("cvss_version"), vectors.canonical_vector(F.col("vector"))
    on = (F.col("cve_id") == F.col("__cve")) & (F.col("source_identifier_raw") == F.col("__source")) & (version == F.col("__version")) & (vector == F.col("__vector"))
    found = rows.join(p, on, "left").withColumn("__m", vectors.components(F.col("vector")))
    base, none = scores.base_score(version, F.col("__m"), F.col("vector"), lookup), F.lit(None).cast("double")
    js, bt = base, none
    if lookup is not None:
        valid = (version == "4.0") & scores.valid_v4(F.col("vector"), F.col("__m"))
        js = F.when(version == "4.0", F.when(valid, scores.score_v4(scores.keep_groups_v4(F.col("__m"), False), lookup, "js"))).otherwise(base)
        bt = F.when(valid, scores.score_v4(scores.keep_groups_v4(F.col("__m"), True), lookup))
    kind = scores.reported_kind(version, F.col("__base"), F.col("__js"), F.col("__bt"), F.col("__score"), F.col("__severity"))
    told = found.withColumns({"__base": base, "__js": js, "__bt": bt}).withColumn("reported_score_type", kind)
    return told.select(*rows.columns, F.col("__score").alias("reported_score"), "reported_score_type", F.col("reported_score_type").isin("ROUNDING_BOUNDARY_EQUIVALENT", "CVSS-B", "CVSS-BT").alias("reported_score_matches"))


def eligibility(forbidden: tuple[str, ...] = Queries().forbidden) -> Column:
    """Why a corpus row is not admitted: the first rule that fails, or null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unreadable = blank("base_vector") | F.contains("base_vector", F.lit("*")) | ~F.contains("base_vector", F.lit("AV:"))
    return (
        F.when(blank("cve_id"), "MISSING_CVE_ID")
        .when(blank("source_key"), "MISSING_SOURCE_KEY")
        .when(blank("cvss_version") | (F.col("cvss_version") == UNKNOWN), "MISSING_CVSS_VERSION")
        .when(unreadable, "BASE_VECTOR_NOT_PARSEABLE")
        .when(F.col("observed_from").isNull(), "MISSING_OBSERVED_FROM")
        .when(blank("source_file"), "MISSING_PROVENANCE")
        .when(F.col("chain_ambiguous"), "AMBIGUOUS_CHAIN")
        .when(blank("evidence_text"), "TEXT_NOT_GENERATED")
        .when(text.contains_any(F.col("evidence_text"), forbidden), "TEXT_CONTAINS_LABEL_WORD")
        .when(F.contains("evidence_text", F.col("replaced_by_evidence_id")), "TEXT_CONTAINS_FUTURE_INFO")
    )


def admit(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded with reason): the two parts of one input."""
    judged = rows.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def reranker_view(rows: DataFrame) -> DataFrame:
    """What rerankers see: nothing that tells of a row's future."""
    view = rows.withColumn("canonical_base_vector", F.col("base_vector")).select(*VIEW)
    assert_blind(view)
    return view


def assert_blind(frame: DataFrame) -> None:
    if seen := sorted(set(frame.columns) & set(FORBIDDEN)):
        raise ValueError(f"columns that tell the future: {seen}")


def source_bucket(key: Column, named: tuple[str, ...]) -> Column:
    return F.when(key.isin(*named), key).otherwise(F.lit("OTHER_SOURCE"))


def profile(accepted: DataFrame, excluded: DataFrame) -> DataFrame:
    """(section, key, value): counts by version, source, split and reason, and duplicates of text."""
    counts = lambda df, c, name: df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("section"), "key", "value")
    twice = accepted.groupBy("evidence_text").agg(F.count("*").alias("c")).where("c > 1").agg(F.lit("duplicate_texts").alias("section"), F.lit("rows").alias("key"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("value"))
    return counts(accepted, "cvss_version", "version").union(counts(accepted, "source_key", "source")).union(counts(accepted, "split", "split")).union(counts(excluded, "reason", "excluded")).union(twice)
