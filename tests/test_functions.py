"""Text, time, vector and score functions against known values."""

import hashlib
import html

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scores, text, times, vectors
from palimpsest.session import prepare


def one(spark, column, **values):
    prepare(spark)
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [(None, ""), ("", ""), (" a \t b\r\n\r\nc \r d ", "a b\nc \n d"), ("a\n\n\nb", "a\nb")])
def test_normalize_whitespace(spark, raw, want):
    assert one(spark, text.normalize_whitespace(F.col("x")), x=raw) == want


def test_compact_texts(spark):
    assert one(spark, text.compact_text(F.col("x")), x=None) == "[NULL]"
    assert one(spark, text.compact_text(F.col("x"), 5), x=" a &amp;  bcdef") == "a & b...[TRUNCATED]"
    assert one(spark, text.compact_normalized_text(F.col("x")), x=" \n ") == "[EMPTY]"
    assert one(spark, text.compact_normalized_text(F.col("x")), x="a &amp;  b&lt;") == "a &amp; b&lt;"
    for raw in ("caf&eacute; &#8211; &#x2013; x", "&notit; &not &NotAName; &", "&amp;lt; &ampx", "&#0; &#128; &#x110000;"):
        assert one(spark, text.compact_text(F.col("x")), x=raw) == " ".join(html.unescape(raw).split())


@pytest.mark.parametrize("raw,want", [(None, "null"), ("null", "null"), ("{}", "dict"), ("[1]", "list"), ("true", "bool"), ("1", "int"), ("1.5", "float"), ('"a"', "string"), ("not json", "string")])
def test_value_shape(spark, raw, want):
    assert one(spark, text.value_shape(F.col("x")), x=raw) == want


def test_canonical_json(spark):
    assert one(spark, text.canonical_json(F.col("x")), x='{"b": 1, "a": [2, "é"]}') == '{"a":[2,"é"],"b":1}'
    assert one(spark, text.canonical_json(F.col("x")), x="plain") == "plain"


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.col("x")), x="CVE-2024-1: AV:N/AC:L, (v3.1). e-mail -- a@b.c.") == ["cve-2024-1", "av:n", "ac:l", "v3.1", "e-mail", "a@b.c"]
    assert one(spark, text.tokenize(F.col("x")), x=None) == []


def test_hashes(spark):
    assert one(spark, text.tie_key(7, F.lit("q"), F.lit("e"))) == hashlib.sha256(b"7|q|e").hexdigest()
    assert one(spark, text.query_id(F.lit("a"), F.lit("b"))) == "q_" + hashlib.sha1(b"a|b").hexdigest()[:16]


def test_ties_are_balanced(spark):
    rows = spark.range(400).select((text.tie_key(1, F.col("id").cast("string"), F.lit("a")) < text.tie_key(1, F.col("id").cast("string"), F.lit("b"))).alias("x"))
    assert 140 < rows.where("x").count() < 260


def test_sentences(spark):
    make = lambda score, sev, old: one(spark, text.evidence_text(F.lit("2024-01-02"), F.lit("NVD"), F.lit("CVE-1"), F.lit("3.1"), F.lit("AV:N"), F.lit(score).cast("double"), F.lit(sev), F.lit(old)))
    assert make(9.8, "CRITICAL", False) == "As of 2024-01-02, NVD assessed CVE-1 under CVSS 3.1 with Base metric vector AV:N, a CVSS-B score of 9.8, and Critical severity."
    assert make(None, None, False) == "As of 2024-01-02, NVD assessed CVE-1 under CVSS 3.1 with Base metric vector AV:N."
    assert make(10.0, "CRITICAL", True) == "At the beginning of the observation window, NVD had an active CVSS 3.1 Base assessment for CVE-1 with Base metric vector AV:N, a CVSS-B score of 10.0, and Critical severity."
    assert one(spark, text.query_text(F.lit("combined"), F.lit("2024-01-02"), F.lit("3.1"), F.lit("NVD"), F.lit("CVE-1"))) == "As of 2024-01-02, what was the current CVSS 3.1 Base assessment issued by NVD for CVE-1?"
    assert one(spark, text.contains_any(F.col("x"), ("current",)), x="ConCURRENTly") is True


@pytest.mark.parametrize("raw,want", [("2024-03-01T10:00:00.000", 1709287200000000), ("2024-03-01T12:00:00+02:00", 1709287200000000), ("2024-03-01T10:00:00Z", 1709287200000000), ("??", None), ("", None)])
def test_utc(spark, raw, want):
    assert one(spark, times.micros(times.parse_utc(F.col("x"))), x=raw) == want


DAY = 86_400_000_000


def test_question_times(spark):
    after = lambda end: one(spark, times.offset_after(F.lit(0).cast("long"), F.lit(end).cast("long"), F.lit(400 * DAY)))
    assert (after(None)["at"], after(20 * DAY)["at"], after(500 * DAY)["at"]) == (30 * DAY, 10 * DAY, 30 * DAY)
    assert after(1_000_000) == (None, "NEW_INTERVAL_TOO_SHORT")
    before = one(spark, times.offset_before(F.lit(100 * DAY), F.lit(90 * DAY), F.lit(0).cast("long")))
    assert before == (95 * DAY, None)
    assert one(spark, times.offset_before(F.lit(5).cast("long"), F.lit(None).cast("long"), F.lit(0).cast("long")))["reason"] == "OLD_INTERVAL_TOO_SHORT"


def test_ages(spark):
    assert one(spark, times.age_days(F.lit(3 * DAY), F.lit(DAY // 2))) == 2.5
    with pytest.raises(Exception, match="visibility violation"):
        one(spark, times.age_days(F.col("x"), F.col("x") + 1), x=1)
    assert one(spark, times.year_text(F.col("x")), x="2024-01") == "2024" and one(spark, times.year_text(F.col("x")), x="n/a") == "[UNKNOWN]"


@pytest.mark.parametrize(
    "raw,source,vector",
    [("NIST CVSS:3.1/AV:N/AC:L", "NIST", "CVSS:3.1/AV:N/AC:L"), ("x (AV:N/AC:L)", "x", "AV:N/AC:L"), ("AV:N/AC:L", "", "AV:N/AC:L"), ("NVD: - AV:L", "NVD:", "AV:L"), ("NVD:- AV:L", "NVD", "AV:L"), ("nothing", "nothing", ""), (None, "", "")],
)
def test_source_and_vector(spark, raw, source, vector):
    assert one(spark, vectors.source_and_vector(F.col("x")), x=raw) == (source, vector)


def test_components(spark):
    assert one(spark, vectors.components(F.col("x")), x="CVSS:3.1/AV:N/AC: L/bad/:x/C:/AV:L") == {"AV": "L", "AC": "L"}
    assert one(spark, vectors.canonical_vector(F.col("x")), x="CVSS:4.0/AV:N") == "AV:N" and one(spark, vectors.canonical_vector(F.col("x")), x="CVSS:4.0") == ""
    assert one(spark, vectors.changed(vectors.components(F.col("a")), vectors.components(F.col("b"))), a="AV:N/AC:L/E:P", b="AV:L/AC:L/S:U") == ["AV", "E", "S"]
    got = one(spark, vectors.classify_changed(F.lit("3.1"), F.array(*map(F.lit, ["AV", "E", "MAV"]))))
    assert (got["changed_base_components"], got["changed_threat_components"], got["changed_environmental_components"], got["threat_only_change"]) == (["AV"], ["E"], ["MAV"], False)
    assert one(spark, vectors.classify_changed(F.lit("4.0"), F.array(F.lit("E"))))["threat_only_change"] is True
    assert one(spark, vectors.base_vector(F.lit("3.1"), vectors.components(F.col("x"))), x="E:P/AC:L/AV:N") == "AV:N/AC:L"
    assert one(spark, vectors.version_of(F.lit("CVSS V3"), F.col("x")), x="CVSS:3.1/AV:N") == "3.1" and one(spark, vectors.version_of(F.lit("CVSS V3"), F.col("x")), x="AV:N") == "3.0"
    assert one(spark, vectors.same_source(F.lit(" NVD  x"), F.lit("nvd x"))) is True and one(spark, vectors.same_source(F.lit(""), F.lit(""))) is False


@pytest.mark.parametrize(
    "version,vector,want,severity",
    [
        ("3.1", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8, "CRITICAL"),
        ("3.1", "AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0, "CRITICAL"),
        ("3.1", "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0, "NONE"),
        ("3.0", "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H", 7.5, "HIGH"),
        ("2.0", "AV:N/AC:L/Au:N/C:P/I:P/A:P", 7.5, "HIGH"),
        ("2.0", "AV:N/AC:L/Au:N/C:N/I:N/A:N", 0.0, "LOW"),
        ("3.1", "AV:N/AC:L", None, None),
    ],
)
def test_scores(spark, version, vector, want, severity):
    m = vectors.components(F.col("x"))
    got = one(spark, scores.base_score(F.lit(version), m, F.col("x")), x=vector)
    assert got == want
    assert one(spark, scores.severity(F.lit(version), F.lit(want).cast("double"))) == severity


#: A few entries of the standard's table, for these tests.
LOOKUP = {"000200": 9.3, "000210": 8.9, "000100": 10.0, "100200": 9.0, "010200": 8.9, "000201": 9.1, "001200": 8.6, "000220": 8.2, "000110": 9.6, "010210": 8.0}


@pytest.mark.parametrize(
    "vector,want",
    [
        ("AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N", 9.3),
        ("AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:H/SI:H/SA:H", 10.0),
        ("AV:N/AC:L/AT:N/PR:N/UI:N/VC:N/VI:N/VA:N/SC:N/SI:N/SA:N", 0.0),
        ("AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N/E:P", 8.9),
    ],
)
def test_score_4(spark, vector, want):
    table = F.create_map(*[F.lit(x) for pair in LOOKUP.items() for x in pair])
    assert one(spark, scores.score_v4(vectors.components(F.col("x")), table), x=vector) == want


def test_score_table_is_checked(spark, tmp_path):
    import json

    from palimpsest.plans.scalar import rule_table

    table = rule_table()
    assert len(table) == 270 and table["000000"] == 10.0
    (tmp_path / "t.json").write_text(json.dumps(table))
    vector = "AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:H/SI:H/SA:H"
    assert one(spark, scores.base_score(F.lit("4.0"), vectors.components(F.col("x")), F.col("x"), scores.read_score_table(str(tmp_path / "t.json"))), x=vector) == table["000100"]
    assert one(spark, scores.base_score(F.lit("4.0"), vectors.components(F.col("x")), F.col("x")), x=vector) is None
    for broken in ({k: v for k, v in table.items() if k != "000000"}, table | {"002000": 1.0}, table | {"212221": 11.0}, table | {"212221": 9.0}):
        with pytest.raises(ValueError):
            scores.score_table(broken)


@pytest.mark.parametrize("vector,ok", [("AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N/U:Red", True), ("AV:N", False), ("AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:Z", False), ("CVSS:3.1/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N", False), ("AV:N/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N", False)])
def test_valid_4(spark, vector, ok):
    assert one(spark, scores.valid_v4(F.col("x"), vectors.components(F.col("x"))), x=vector) is ok


def test_rounding(spark):
    assert one(spark, scores.round_decimal(F.col("x")), x=5.6499999999999995) == 5.7 and one(spark, scores.round_js(F.col("x")), x=5.6499999999999995) == 5.6
    assert one(spark, scores.reported_kind(F.lit("4.0"), F.lit(5.7), F.lit(5.6), F.lit(None).cast("double"), F.lit(5.7), F.lit("MEDIUM"))) == "ROUNDING_BOUNDARY_EQUIVALENT"
    assert one(spark, scores.reported_kind(F.lit("3.1"), F.lit(5.7), F.lit(5.7), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("x"))) == "NOT_AVAILABLE_IN_HISTORY"
