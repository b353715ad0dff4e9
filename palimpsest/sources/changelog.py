"""Change-history pages and entity pages: nested JSON to flat rows, with the malformed parts on the side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import MISSING
from palimpsest.functions import times, vectors
from palimpsest.functions.text import variant_shape

RECORD = "source_file string, change_pos int, cve_id string, event_name string, change_id string, source_identifier string, created string, created_at long, action string, detail_type string, old_value string, new_value string, detail_index int"


def read_texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """source_file (its name) and text of every file; a byte order mark is dropped."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("text"))


def _part(v: str, path: str) -> F.Column:
    """A part of a variant, or null."""
    return F.try_variant_get(F.col(v), path, "variant")


def _json(v: str, path: str) -> F.Column:
    """A part of a variant as JSON text, or null."""
    return F.to_json(_part(v, path))


def _string(v: str, path: str) -> F.Column:
    return F.try_variant_get(F.col(v), path, "string")


def _levels(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, changes and details with their shapes; every level keeps what is malformed."""
    page = pages.withColumn("page", F.try_parse_json("text"))
    page = page.withColumns({"page_shape": variant_shape(F.col("page")), "changes_shape": variant_shape(_part("page", "$.cveChanges"))})
    change = page.where(F.col("changes_shape") == "list").select("source_file", F.posexplode(F.try_variant_get("page", "$.cveChanges", "array<variant>")).alias("change_pos", "wrapper"))
    change = change.withColumns({"wrapper_shape": variant_shape(F.col("wrapper")), "change_shape": variant_shape(_part("wrapper", "$.change")), "change": _part("wrapper", "$.change")})
    flat = change.withColumns(
        {
            "cve_id": F.coalesce(_string("change", "$.cveId"), F.lit(MISSING)),
            "event_name": F.coalesce(_string("change", "$.eventName"), F.lit(MISSING)),
            "change_id": F.coalesce(_string("change", "$.cveChangeId"), F.lit(MISSING)),
            "source_identifier": F.coalesce(_string("change", "$.sourceIdentifier"), F.lit(MISSING)),
            "created": F.coalesce(F.nullif(_string("change", "$.created"), F.lit("")), F.lit(MISSING)),
            "details_shape": variant_shape(_part("change", "$.details")),
            "has_details": _part("change", "$.details").isNotNull(),
        }
    )
    flat = flat.withColumn("created_at", times.micros(times.parse_utc(F.col("created"))))
    details = F.try_variant_get("change", "$.details", "array<variant>")
    detail = flat.where((F.col("change_shape") == "dict") & (F.col("details_shape").isin("list", "null"))).select("*", F.posexplode_outer(F.when(F.col("details_shape") == "list", details)).alias("pos", "detail"))
    detail = detail.withColumn("detail_shape", F.when(F.col("pos").isNotNull(), variant_shape(F.col("detail"))))
    return page, flat, detail


def records(pages: DataFrame) -> DataFrame:
    """One row for each detail of each change; a change without details gives one with detail_index -1.

    pages: source_file and text. Malformed parts are left out here and listed by ``issues``. Values that are not strings
    are compact JSON with sorted keys.
    """
    detail = _levels(pages)[2].where(F.col("pos").isNull() | (F.col("detail_shape") == "dict"))
    value = lambda name: F.coalesce(_string("detail", f"$.{name}"), _json("detail", f"$.{name}"))
    return detail.select(
        "source_file", "change_pos", "cve_id", "event_name", "change_id", "source_identifier", "created", "created_at",
        _string("detail", "$.action").alias("action"), _string("detail", "$.type").alias("detail_type"),
        value("oldValue").alias("old_value"), value("newValue").alias("new_value"), F.coalesce("pos", F.lit(-1)).alias("detail_index"),
    )


def issues(pages: DataFrame) -> DataFrame:
    """source_file, change_pos, detail_index and kind of everything malformed, of six kinds.

    CREATED_UNPARSEABLE only flags a time that can't be parsed; its rows stay.
    """
    page, change, _ = _levels(pages)
    none = F.lit(None).cast("int")
    issue = lambda test, kind, at=none: F.when(test, F.struct(at.alias("detail_index"), F.lit(kind).alias("kind")))
    known = lambda *found: F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    whole = F.coalesce(F.col("page_shape"), F.lit("null")) == "dict"
    broken = page.where(~whole | (F.col("changes_shape") != "list")).select("source_file", none.alias("change_pos"), known(issue(~whole, "PAGE_READ_ERROR"), issue(whole, "CVE_CHANGES_NOT_LIST")).alias("x"))
    # One pass over the changes: each with all that is wrong with it and its details.
    fine, listed = (F.col("wrapper_shape") == "dict") & (F.col("change_shape") == "dict"), F.col("details_shape").isin("list", "null")
    parts = F.transform(F.when((F.col("change_shape") == "dict") & (F.col("details_shape") == "list"), F.try_variant_get("change", "$.details", "array<variant>")), lambda d, i: issue(variant_shape(d) != "dict", "DETAIL_NOT_DICT", i))
    own = F.array(
        issue(~fine, "CHANGE_NOT_DICT"), issue((F.col("change_shape") == "dict") & ~listed, "DETAILS_NOT_LIST"),
        issue((F.col("change_shape") == "dict") & (F.col("created") != MISSING) & F.col("created_at").isNull(), "CREATED_UNPARSEABLE"),
    )
    wrong = F.filter(F.concat(own, F.coalesce(parts, F.array().cast("array<struct<detail_index:int,kind:string>>"))), lambda x: x.isNotNull())
    out = broken.unionByName(change.select("source_file", "change_pos", F.explode(wrong).alias("x")))
    return out.select("source_file", "change_pos", "x.detail_index", "x.kind")


def empty_details(pages: DataFrame) -> DataFrame:
    """source_file, change_pos and class of every change: DETAILS_KEY_MISSING, DETAILS_NULL, DETAILS_NOT_LIST:type,
    DETAILS_EMPTY_LIST, NO_DICT_DETAIL or null."""
    change = _levels(pages)[1].where(F.col("change_shape") == "dict")
    inside = F.try_variant_get("change", "$.details", "array<variant>")
    dicts = F.exists(inside, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    kind = (
        F.when(~F.col("has_details"), "DETAILS_KEY_MISSING")
        .when(F.col("details_shape") == "null", "DETAILS_NULL")
        .when(F.col("details_shape") != "list", F.concat(F.lit("DETAILS_NOT_LIST:"), F.when(F.col("details_shape") == "string", "str").otherwise(F.col("details_shape"))))
        .when(F.size(inside) == 0, "DETAILS_EMPTY_LIST")
        .when(~dicts, "NO_DICT_DETAIL")
    )
    return change.select("source_file", "change_pos", kind.alias("class"))


def reported_scores(pages: DataFrame) -> DataFrame:
    """Published scores by (cve_id, source, version, canonical vector) from entity pages; of a key the last one counts.

    Entries without a vector or a score are skipped. Last: by file name, then by place in the file, then by family.
    """
    v = pages.select("source_file", F.posexplode(F.try_variant_get(F.try_parse_json("text"), "$.vulnerabilities", "array<variant>")).alias("pos", "item"))
    families = (("cvssMetricV40", "4.0"), ("cvssMetricV31", "3.1"), ("cvssMetricV30", "3.0"), ("cvssMetricV2", "2.0"))


    def entries(key: str, version: str) -> F.Column:
        found = F.coalesce(F.try_variant_get("item", f"$.cve.metrics.{key}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(found, lambda e: F.struct(F.lit(version).alias("version"), e.alias("entry")))

    arrays = [entries(key, version) for key, version in families]
    each = v.select("source_file", "pos", _string("item", "$.cve.id").alias("cve_id"), F.posexplode(F.concat(*arrays)).alias("at", "x"))
    each = each.select("source_file", "pos", "at", "cve_id", "x.version", F.col("x.entry").alias("entry"))
    flat = each.select(
        "source_file", "pos", "at", "cve_id", "version", _string("entry", "$.source").alias("source"), _string("entry", "$.cvssData.vectorString").alias("vector_string"),
        F.try_variant_get("entry", "$.cvssData.baseScore", "double").alias("reported_score"), F.coalesce(_string("entry", "$.cvssData.baseSeverity"), _string("entry", "$.baseSeverity")).alias("reported_severity"),
    ).where((F.col("vector_string") != "") & F.col("reported_score").isNotNull())
    keyed = flat.withColumn("vector", vectors.canonical_vector(F.col("vector_string")))
    last = F.max_by(F.struct("reported_score", "reported_severity", "vector_string"), F.struct("source_file", "pos", "at")).alias("last")
    return keyed.groupBy("cve_id", "source", "version", "vector").agg(last).select("cve_id", "source", "version", "vector", "last.*")
