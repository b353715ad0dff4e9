"""Reading changes and replaying chains: scenarios."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.config import Timeline
from palimpsest.operators import timeline
from palimpsest.session import prepare
from palimpsest.sources import changelog

A, B, C = (f"CVSS:3.1/AV:{x}/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H" for x in "NLP")
DAY = 86_400_000_000


def change(when, *details, name="CVE Modified", cve="CVE-1", source="s1", n=[0]):
    n[0] += 1
    made = [{"action": a, "type": t, ("oldValue" if a == "Removed" else "newValue"): f"NIST {v}"} for a, v, *rest in details for t in [rest[0] if rest else "CVSS V3.1"]]
    return {"change": {"cveId": cve, "eventName": name, "cveChangeId": f"c{n[0]:05d}", "sourceIdentifier": source, "created": when, "details": made}}


def pages(spark, *texts):
    prepare(spark)
    return spark.createDataFrame([(f"p{i}.json", t if isinstance(t, str) else json.dumps({"cveChanges": t})) for i, t in enumerate(texts)], "source_file string, text string")


def replay(spark, *changes):
    events = timeline.chain_events(changelog.records(pages(spark, list(changes))))
    rows, reports, crossings = (x.collect() for x in timeline.replay(events))
    return sorted(rows, key=lambda r: (r["chain_id"], r["sequence"])), reports, crossings


def day(n):
    return f"2024-03-{n:02d}T10:00:00.000"


def test_strict_replacement(spark):
    rows, reports, _ = replay(spark, change(day(1), ("Added", A)), change(day(5), ("Removed", A), ("Added", B)))
    old, new = rows
    assert (old["timeline_status"], old["replacement_type"], new["timeline_status"]) == ("REPLACED", "STRICT_SAME_CHANGE", "ACTIVE")
    assert old["superseded_by_evidence_id"] == new["evidence_id"] and new["replaces_evidence_id"] == old["evidence_id"]
    assert old["valid_until"] == new["valid_from"] and old["changed_components"] == ["AV"] and old["base_components_changed"] and new["valid_until_censored"]
    assert not reports[0]["ambiguous"]


def test_left_censored(spark):
    rows, _, _ = replay(spark, change(day(5), ("Removed", A), ("Added", B)))
    assert rows[0]["valid_from"] is None and rows[0]["valid_from_censored"] and rows[0]["observed_from"] == 1704067200000000 and not rows[0]["chain_ambiguous"]


def test_additions_and_removals(spark):
    assert [r["timeline_status"] for r in replay(spark, change(day(1), ("Added", A)))[0]] == ["INITIAL_ADDITION"]
    rows, _, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", A)))
    assert (rows[0]["timeline_status"], rows[0]["superseded_by_evidence_id"]) == ("WITHDRAWN_WITHOUT_REPLACEMENT", None)


def test_cross_event(spark):
    rows, _, crossings = replay(spark, change("2024-01-01T10:00:00.000", ("Added", A)), change("2024-01-02T10:00:00.000", ("Removed", A)), change("2024-03-03T10:00:00.000", ("Added", B)))
    assert (rows[0]["timeline_status"], rows[0]["replacement_type"], rows[0]["superseded_by_evidence_id"], rows[1]["replaces_evidence_id"]) == ("REPLACED", "HIGH_CONFIDENCE_CROSS_EVENT", None, rows[0]["evidence_id"])
    assert crossings[0]["gap_days"] == 61.0 and rows[0]["changed_components"] == ["AV"]


def test_same_value_again_and_reversal(spark):
    rows, _, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", A)), change(day(3), ("Added", A)))
    assert (rows[0]["timeline_status"], rows[1]["readded_same_value"], rows[1]["explicit_reversal"]) == ("WITHDRAWN_WITHOUT_REPLACEMENT", True, False)
    rows, _, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", A), ("Added", B)), change(day(3), ("Removed", B), ("Added", A)))
    assert [r["explicit_reversal"] for r in rows] == [False, False, True]


def test_two_sources_and_alias(spark):
    rows, _, _ = replay(spark, change(day(1), ("Added", A), source="nvd@nist.gov"), change(day(2), ("Added", B), source="s2"))
    assert sorted(r["source_key"] for r in rows) == ["NVD", "s2"] and all(r["replaces_evidence_id"] is None for r in rows)


def test_rewrite_and_competition(spark):
    rows, reports, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", A), ("Added", A)), change(day(3), ("Added", C)))
    assert len(rows) == 2 and reports[0]["rewrites"] == 1 and reports[0]["competing"] == 1
    assert all(r["ambiguity_reason"] == ["MULTIPLE_COMPETING_ACTIVE_VALUES"] and r["chain_ambiguous"] for r in rows)


def test_version_change_splits_the_chain(spark):
    old = A.replace("3.1", "3.0")
    rows, _, _ = replay(spark, change(day(1), ("Removed", old, "CVSS V3"), ("Added", B, "CVSS V3.1")))
    assert sorted(r["cvss_version"] for r in rows) == ["3.0", "3.1"] and not [r for r in rows if r["replacement_type"]]


def test_prefix_is_no_difference(spark):
    bare = B.split("/", 1)[1]
    rows, _, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", A), ("Added", bare)), change(day(3), ("Removed", B), ("Added", C)))
    assert [r["replacement_type"] for r in rows] == ["STRICT_SAME_CHANGE", "STRICT_SAME_CHANGE", None]


@pytest.mark.parametrize(
    "changes,reason",
    [
        ([("Added", A)], None),
        ([("Added", A), ("Removed", B)], "REMOVAL_OF_UNOBSERVED_VALUE_AFTER_OTHER_EVENTS"),
        ([("Added", A), ("Removed", A), ("Removed", A)], "REMOVAL_OF_INACTIVE_VALUE"),
    ],
)
def test_ambiguity(spark, changes, reason):
    _, reports, _ = replay(spark, *[change(day(i + 1), c) for i, c in enumerate(changes)])
    assert reports[0]["reasons"] == ([reason] if reason else [])


def test_ambiguous_pairs(spark):
    _, reports, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", B), ("Added", C)))
    assert "STRICT_PAIR_OLD_VALUE_NOT_ACTIVE" in reports[0]["reasons"]
    _, reports, _ = replay(spark, change(day(1), ("Added", A)), change(day(2), ("Removed", A), ("Added", B), ("Added", C)))
    assert reports[0]["reasons"] == ["MULTI_REMOVED_OR_ADDED_IN_ONE_CHANGE", "MULTIPLE_COMPETING_ACTIVE_VALUES"]


def test_order_of_input_does_not_matter(spark):
    made = [change(day(1), ("Added", A)), change(day(2), ("Removed", A), ("Added", B)), change(day(3), ("Removed", B), ("Added", C))]
    assert replay(spark, *made)[0] == replay(spark, *reversed(made))[0]


def test_window_functions_equal_the_replay_of_additions_replaced(spark, sf):
    """Chains of strict pairs alone: the state machine and the window functions give the same intervals."""
    from palimpsest.sources import adapters

    a = adapters.intervals(spark, sf).where("entity < 12")
    rows = a.select("entity", "source", "seq", "value", "valid_from", "valid_until").collect()
    letter = "NALP"
    vec = lambda v: f"CVSS:3.1/AV:{letter[v]}/AC:L"
    held, made = {}, []
    for r in sorted(rows, key=lambda r: r["valid_from"]):
        key = (r["entity"], r["source"])
        when = f"2024-01-01T00:00:00.{0:06d}"
        details = ([("Removed", held[key])] if key in held else []) + [("Added", vec(r["value"]))]
        held[key] = vec(r["value"])
        c = change(when, *details, cve=str(r["entity"]), source=r["source"])
        c["change"]["created"] = __import__("datetime").datetime.fromtimestamp(r["valid_from"] / 1e6, __import__("datetime").timezone.utc).isoformat(timespec="microseconds")
        made.append(c)
    got, _, _ = replay(spark, *made)
    want = {(str(r["entity"]), r["source"], r["seq"]): (r["valid_from"], r["valid_until"], vec(r["value"]).split("/", 1)[1]) for r in rows}
    assert {(r["cve_id"], r["source_key"], r["sequence"]): (r["valid_from"], r["valid_until"], r["vector"]) for r in got} == want


@pytest.mark.parametrize(
    "old,new,kw,tier,reasons",
    [
        (A, B, {}, "STRICT", []),
        (A, A, {}, "EXCLUDED", ["NO_METRIC_CHANGE"]),
        (A, B, {"event": "Data Remediation"}, "EXCLUDED", ["ADMINISTRATIVE_OR_BULK_EVENT"]),
        (A, B, {"event": "Some Event"}, "MODERATE", []),
        (A, B.replace("3.1", "3.0"), {}, "EXCLUDED", ["CVSS_VERSION_CHANGED"]),
        (A, "", {}, "EXCLUDED", ["NEW_VECTOR_NOT_FOUND"]),
        (A, "nonsense", {}, "EXCLUDED", ["NEW_VECTOR_NOT_PARSEABLE"]),
        (A, B, {"removed": 2}, "EXCLUDED", ["REMOVED_COUNT_NOT_ONE"]),
        (A, B, {"kind": "Reference"}, "EXCLUDED", ["UNSUPPORTED_CVSS_DETAIL_TYPE"]),
        (A, B, {"event": "Some Event", "source": "other"}, "MODERATE", ["SOURCE_CHANGED_OR_MISSING"]),
    ],
)
def test_tiers(spark, old, new, kw, tier, reasons):
    prepare(spark)
    c = timeline.classify_pair(F.lit(kw.get("event", "CVE Modified")), F.lit(kw.get("kind", "CVSS V3.1")), F.lit("NIST"), F.lit(kw.get("source", "nist ")), F.lit(old), F.lit(new), F.lit(kw.get("removed", 1)), F.lit(1))
    got = spark.range(1).select(c.alias("c")).first()["c"]
    assert got["tier"] == tier and set(reasons) <= set(got["reasons"]) and (tier == "STRICT") <= (got["reasons"] == [])


def test_replacement_candidates(spark):
    made = [change(day(1), ("Removed", A), ("Added", B)), change(day(2), ("Removed", A), ("Removed", B), ("Added", C)), change(day(3), ("Added", A))]
    rows = sorted(timeline.replacements(changelog.records(pages(spark, made))).collect(), key=lambda r: r["change_id"])
    assert [(r["tier"], r["removed_count"], r["removed_detail_index"]) for r in rows] == [("STRICT", 1, 0), ("EXCLUDED", 2, -1)]
    assert rows[0]["changed_components"] == ["AV"] and rows[0]["same_source"]
    stats = timeline.pair_statistics(timeline.chain_events(changelog.records(pages(spark, made)))).first()
    assert (stats["candidates"], stats["multi_removed_or_added"]) == (2, 1)


def test_reader(spark):
    wrong = [
        change(day(1), ("Added", A)),
        change(day(2)),
        "text",
        {"change": [1]},
        {"change": {"cveId": "C", "details": "no"}},
        {"change": {"cveId": "C", "created": "??", "details": [5, {"action": "Added", "type": "T", "newValue": {"b": 1, "a": None}}]}},
        {"change": {"cveId": "C"}},
    ]
    p = pages(spark, wrong, "no json", "[]", json.dumps({"cveChanges": {}}))
    rows = sorted(changelog.records(p).collect(), key=lambda r: (r["change_pos"], r["detail_index"]))
    assert [(r["change_pos"], r["detail_index"], r["action"]) for r in rows] == [(0, 0, "Added"), (1, -1, None), (5, 1, "Added"), (6, -1, None)]
    assert rows[2]["new_value"] == '{"a":null,"b":1}' and rows[2]["event_name"] == "[MISSING]"
    found = sorted((r["source_file"], r["kind"]) for r in changelog.issues(p).collect())
    assert found == [("p0.json", "CHANGE_NOT_DICT"), ("p0.json", "CHANGE_NOT_DICT"), ("p0.json", "CREATED_UNPARSEABLE"), ("p0.json", "DETAILS_NOT_LIST"), ("p0.json", "DETAIL_NOT_DICT"), ("p1.json", "PAGE_READ_ERROR"), ("p2.json", "PAGE_READ_ERROR"), ("p3.json", "CVE_CHANGES_NOT_LIST")]
    kinds = {r["change_pos"]: r["class"] for r in changelog.empty_details(p).collect()}
    assert kinds == {0: None, 1: "DETAILS_EMPTY_LIST", 4: "DETAILS_NOT_LIST:str", 5: None, 6: "DETAILS_KEY_MISSING"}


def test_files_with_a_byte_order_mark(spark, tmp_path):
    prepare(spark)
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"cveChanges": [change(day(1), ("Added", A))]}), encoding="utf-8")
    (tmp_path / "b.txt").write_text("ignored")
    texts = changelog.read_texts(spark, str(tmp_path))
    assert [r["source_file"] for r in texts.collect()] == ["a.json"] and changelog.records(texts).count() == 1


def test_published_scores(spark):
    entity = lambda score: {"cve": {"id": "C", "metrics": {"cvssMetricV31": [{"source": "s", "cvssData": {"vectorString": A, "baseScore": score, "baseSeverity": "HIGH"}}, {"source": "s", "cvssData": {"vectorString": None}}], "cvssMetricV2": [{"source": "s", "baseSeverity": "LOW", "cvssData": {"vectorString": "AV:N", "baseScore": 2}}]}}}
    p = pages(spark, json.dumps({"vulnerabilities": [entity(7.0), entity(8.0)]}))
    rows = sorted(changelog.reported_scores(p).collect(), key=lambda r: r["version"])
    assert [(r["version"], r["vector"], r["reported_score"], r["reported_severity"]) for r in rows] == [("2.0", "AV:N", 2.0, "LOW"), ("3.1", A.split("/", 1)[1], 8.0, "HIGH")]


def test_inference_can_be_turned_off(spark):
    events = timeline.chain_events(changelog.records(pages(spark, [change(day(5), ("Removed", A))])))
    rows, reports, _ = timeline.replay(events, Timeline(infer_first_removal=False))
    assert rows.count() == 0 and reports.first()["unmatched_removed"] == 1
