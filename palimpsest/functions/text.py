"""Text: normalising, tokens, hashes and templates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.config import EMPTY, NULL, TRUNCATED

def unescape(text: Column) -> Column:
    """Decode all character references of HTML: named ones (also without a semicolon where HTML allows it), decimal and hexadecimal ones.

    A batch of texts at a time: the names are over two thousand, and the longest that fits counts.
    """

    def decoded(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decoded, "string")(text)


def normalize_whitespace(text: Column) -> Column:
    """Null gives "". Character references stay. Line ends become LF; runs of blanks one space, runs of LF one LF; the ends are stripped."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "\n+", "\n"), r"^\s+|\s+$", "")


def _cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(TRUNCATED))).otherwise(text)


def compact_text(text: Column, limit: int = 500) -> Column:
    """One line of at most ``limit`` characters; null gives [NULL]."""
    flat = F.regexp_replace(F.regexp_replace(unescape(text), r"(?U)\s+", " "), "^ | $", "")
    return F.when(text.isNull(), F.lit(NULL)).otherwise(_cut(flat, limit))


def compact_normalized_text(text: Column, limit: int = 1200) -> Column:
    """As normalised, at most ``limit`` characters; nothing gives [EMPTY]."""
    flat = normalize_whitespace(text)
    return F.when(flat == "", F.lit(EMPTY)).otherwise(_cut(flat, limit))


def value_shape(json: Column) -> Column:
    """null, dict, list, bool, int, float or string of a JSON text."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return (
        F.when(json.isNull() | (kind == "VOID"), "null")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .otherwise("string")
    )


def variant_shape(v: Column) -> Column:
    """``value_shape`` of a variant: told by its outermost level, so that what is inside isn't written out or looked through."""
    whole = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "null")
        .when(whole("array<variant>"), "list")
        .when(whole("map<string,variant>"), "dict")
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .otherwise("string")
    )


def canonical_json(json: Column) -> Column:
    """Compact JSON with sorted keys; what is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def tokenize(text: Column) -> Column:
    """Lower case; / separates; words of letters, digits and .:@- stripped of .:- at both ends."""
    parts = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("/"), F.lit(" ")), r"[^a-z0-9.:@\-]+")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(".:-"))), lambda x: x != "")


def tie_key(seed: int, query_id: Column, evidence_id: Column) -> Column:
    """What breaks ties of score: a hash that tells nothing of time."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), query_id, evidence_id), 256)


def query_id(*parts: Column) -> Column:
    return F.concat(F.lit("q_"), F.left(F.sha1(F.concat_ws("|", *parts).cast("binary")), F.lit(16)))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is in the text, in any case, within longer words too."""
    low = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(low, F.lit(word.lower()))
    return found


def severity_word(severity: Column) -> Column:
    return F.initcap(F.coalesce(severity, F.lit("unknown")))


def evidence_text(date: Column, source: Column, entity: Column, version: Column, vector: Column, score: Column, severity: Column, censored: Column) -> Column:
    """A document's sentence: one for values of before the window, one without a score, one with it.

    Fixed values: the wording of the three sentences.
    """
    who = F.concat(source, F.lit(" assessed "), entity, F.lit(" under CVSS "), version, F.lit(" with Base metric vector "), vector)
    tail = F.concat(F.lit(", a CVSS-B score of "), score.cast("string"), F.lit(", and "), severity_word(severity), F.lit(" severity."))
    old = F.concat(F.lit("At the beginning of the observation window, "), source, F.lit(" had an active CVSS "), version, F.lit(" Base assessment for "), entity, F.lit(" with Base metric vector "), vector)
    dated = F.concat(F.lit("As of "), date, F.lit(", "))
    none = F.concat(F.lit(", a CVSS-B score of None, and "), severity_word(severity), F.lit(" severity."))
    return F.when(censored, F.concat(old, F.coalesce(tail, none))).when(score.isNull(), F.concat(dated, who, F.lit("."))).otherwise(F.concat(dated, who, tail))


def query_text(template: Column, date: Column, version: Column, source: Column, entity: Column) -> Column:
    """A question's sentence by its template; null for an unknown one. The wording of the four sentences."""
    start = F.concat(F.lit("As of "), date, F.lit(", what was the current "))
    by = F.concat(F.lit(" issued by "), source, F.lit(" for "), entity)
    return (
        F.when(template == "base_vector", F.concat(start, F.lit("CVSS "), version, F.lit(" Base metric vector"), by, F.lit("?")))
        .when(template == "cvssb_score", F.concat(start, F.lit("CVSS-B score"), by, F.lit(" under CVSS "), version, F.lit("?")))
        .when(template == "base_severity", F.concat(start, F.lit("Base severity"), by, F.lit(" under CVSS "), version, F.lit("?")))
        .when(template == "combined", F.concat(start, F.lit("CVSS "), version, F.lit(" Base assessment"), by, F.lit("?")))
    )
