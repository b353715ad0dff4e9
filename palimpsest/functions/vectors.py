"""Metric vectors such as ``CVSS:3.1/AV:N/AC:L/...``: finding, parsing, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.config import UNKNOWN
from palimpsest.functions.text import normalize_whitespace

#: Where a vector begins in a text.
START = r"(CVSS:4\.0/|CVSS:3\.1/|CVSS:3\.0/|\(AV:|\bAV:)"
#: Version by prefix, and by the type of a change's detail.
PREFIXES = (("CVSS:4.0/", "4.0"), ("CVSS:3.1/", "3.1"), ("CVSS:3.0/", "3.0"))
TYPES = (("CVSS V4.0", "4.0"), ("CVSS V3.1", "3.1"), ("CVSS V3", "3.0"), ("CVSS V2", "2.0"))
#: Base metrics of each version, in the order they are written.
BASE_ORDER = {
    "2.0": ("AV", "AC", "Au", "C", "I", "A"),
    "3.0": ("AV", "AC", "PR", "UI", "S", "C", "I", "A"),
    "3.1": ("AV", "AC", "PR", "UI", "S", "C", "I", "A"),
    "4.0": ("AV", "AC", "AT", "PR", "UI", "VC", "VI", "VA", "SC", "SI", "SA"),
}
#: The other metric groups. What is in none of them is a base metric, but for 4.0, where it is unknown.
TEMPORAL = ("E", "RL", "RC")
ENVIRONMENTAL = {
    "2.0": ("CDP", "TD", "CR", "IR", "AR"),
    "3": ("CR", "IR", "AR", "MAV", "MAC", "MPR", "MUI", "MS", "MC", "MI", "MA"),
    "4.0": ("CR", "IR", "AR", "MAV", "MAC", "MAT", "MPR", "MUI", "MVC", "MVI", "MVA", "MSC", "MSI", "MSA"),
}
SUPPLEMENTAL = ("S", "AU", "R", "V", "RE", "U")
GROUPS = ("base", "threat", "environmental", "supplemental", "unknown")


def _start(text: Column) -> Column:
    return F.regexp_instr(text, F.lit(START))


def _no_parentheses(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^\(.*\)$"), F.btrim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def source_and_vector(raw: Column) -> Column:
    """struct(source, vector): what stands before the first vector, and the vector. Without one all is source."""
    text = normalize_whitespace(raw)
    at = _start(text)
    before = F.btrim(F.rtrim(F.btrim(F.left(text, at - 1)), F.lit(":-")))
    after = _no_parentheses(F.btrim(F.substring(text, at, F.length(text))))
    return F.when(at > 0, F.struct(before.alias("source"), after.alias("vector"))).otherwise(F.struct(text.alias("source"), F.lit("").alias("vector")))


def normalize_vector(vector: Column) -> Column:
    return F.replace(_no_parentheses(normalize_whitespace(vector)), F.lit(" "), F.lit(""))


def canonical_vector(vector: Column) -> Column:
    """The normalised vector without its version prefix."""
    return F.regexp_replace(normalize_vector(vector), "^CVSS:[^/]*/?", "")


def components(vector: Column) -> Column:
    """map of metric to value. Parts without a colon, a name or a value are left out; of repeated names the last counts.

    Needs spark.sql.mapKeyDedupPolicy=LAST_WIN for repeated names.
    """
    parts = F.split(canonical_vector(vector), "/")
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:?", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != "")))


def parseable(vector: Column) -> Column:
    return F.map_contains_key(components(vector), "AV")


def version_of(detail_type: Column, vector: Column) -> Column:
    """By the vector's prefix, else by the detail's type, else [UNKNOWN]."""
    normal = normalize_vector(vector)
    found = F.lit(UNKNOWN)
    for name, version in reversed(TYPES):
        found = F.when(detail_type == name, F.lit(version)).otherwise(found)
    for prefix, version in reversed(PREFIXES):
        found = F.when(F.startswith(normal, F.lit(prefix)), F.lit(version)).otherwise(found)
    return found


def same_source(a: Column, b: Column) -> Column:
    flat = lambda x: F.btrim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.coalesce((flat(a) != "") & (flat(a) == flat(b)), F.lit(False))


def changed(old: Column, new: Column) -> Column:
    """Sorted names whose values differ between two component maps; a missing one differs from any."""
    names = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(names, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))


def group_of(version: Column, name: Column) -> Column:
    """Which of GROUPS a metric belongs to."""
    four = (
        F.when(name.isin(*BASE_ORDER["4.0"]), "base").when(name == "E", "threat").when(name.isin(*ENVIRONMENTAL["4.0"]), "environmental").when(name.isin(*SUPPLEMENTAL), "supplemental").otherwise("unknown")
    )
    env = F.when(version == "2.0", name.isin(*ENVIRONMENTAL["2.0"])).otherwise(name.isin(*ENVIRONMENTAL["3"]))
    return F.when(version == "4.0", four).otherwise(F.when(name.isin(*TEMPORAL), "threat").when(env, "environmental").otherwise("base"))


def classify_changed(version: Column, names: Column) -> Column:
    """struct of one array for each group, base_components_changed and threat_only_change."""

    def of(group: str) -> Column:
        return F.filter(names, lambda k: group_of(version, k) == group)

    arrays = {g: of(g) for g in GROUPS}
    only = F.size(arrays["threat"]) > 0
    for g in ("base", "environmental", "supplemental", "unknown"):
        only = only & (F.size(arrays[g]) == 0)
    fields = [arrays[g].alias(f"changed_{g}_components") for g in GROUPS]
    return F.struct(*fields, (F.size(arrays["base"]) > 0).alias("base_components_changed"), only.alias("threat_only_change"))


def base_vector(version: Column, parts: Column) -> Column:
    """The base metrics alone, in order; missing ones are skipped."""
    found = F.lit("")
    for name, order in BASE_ORDER.items():
        text = F.array_join(F.filter(F.transform(F.array(*map(F.lit, order)), lambda k: F.concat(k, F.lit(":"), F.try_element_at(parts, k))), lambda x: x.isNotNull()), "/")
        found = F.when(version == name, text).otherwise(found)
    return found
