"""The replay machine: what must hold of any chain, told from its events alone, and chains whose intervals are known.

All its rows are compared with a recursive query besides (``plans.replayed``)."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.config import Timeline
from palimpsest.operators import replay, timeline
from tests import plain_replay

DAY = 86_400_000_000


def random_chain(rng):
    """Changes of one chain: additions, removals, pairs and crowds of a few values, some at the same time."""
    values = [("v" + c, c != "d") for c in "abcd"]
    at, changes = 0, []
    for c in range(rng.randint(1, 9)):
        at += rng.choice([0, 1, 1, 40]) * DAY
        n = rng.choice([1, 1, 1, 2, 2, 2, 3])
        made = []
        for i in range(n):
            vector, fine = rng.choice(values)
            action = rng.choice(["Removed", "Added"]) if n != 2 or rng.random() < 0.3 else ["Removed", "Added"][i]
            made.append({"action": action, "vector": vector, "parseable": fine, "parts": vector if fine else "x", "event_id": f"c{c}#{i}", "change_id": f"c{c}", "created_at": at})
        gone, came = ([e for e in made if e["action"] == a] for a in ("Removed", "Added"))
        tier, reasons = "MODERATE", []
        if len(gone) == len(came) == 1:
            if gone[0]["vector"] == came[0]["vector"]:
                tier, reasons = "EXCLUDED", ["NO_METRIC_CHANGE"] if rng.random() < 0.8 else []
            elif rng.random() < 0.6:
                tier = "STRICT"
        for e in made:
            e |= {"tier": tier, "reasons": reasons, "detail_type": "T", "source_identifier_raw": "s", "vector_raw": e["vector"], "source_file": "f"}
        changes.append(made)
    return changes


def kind_of(change):
    """What a change is: a strict pair, a rewrite of one value, or loose events."""
    gone, came = ([e for e in change if e["action"] == a] for a in ("Removed", "Added"))
    if len(gone) == len(came) == 1:
        if came[0]["tier"] == "STRICT":
            return "strict"
        if "NO_METRIC_CHANGE" in came[0]["reasons"] and gone[0]["vector"] == came[0]["vector"]:
            return "rewrite"
    return "loose"


EVENT = "cve_id string, cvss_version string, source_key string, event_id string, change_id string, created_at long, action string, detail_type string, source_identifier_raw string, vector string, vector_raw string, source_file string, tier string, reasons array<string>, parseable boolean, parts string, detail_index int, began struct<created_at:long,change_id:string,detail_index:int>"


def replayed(spark, chains, infer=True):
    """Intervals, report and crossings of each chain, by number; all are replayed in one go."""
    rows = []
    for n, changes in chains.items():
        for c, change in enumerate(changes):
            began = (change[0]["created_at"], f"c{c:03d}", 0)
            rows += [("C", "", str(n), e["event_id"], e["change_id"], e["created_at"], e["action"], e["detail_type"], "s", e["vector"], e["vector_raw"], "f", e["tier"], e["reasons"], e["parseable"], e["parts"], i, began) for i, e in enumerate(change)]
    frames = timeline.replay_paired(spark.createDataFrame(rows, EVENT), Timeline(window_start="1970-01-01T00:00:00.000005+00:00", infer_first_removal=infer))
    found = {n: ([], [], []) for n in chains}
    for i, frame in enumerate(frames):
        for r in frame.collect():
            found[type(next(iter(chains)))(r["source_key"])][i].append(r.asDict())
    return {n: (sorted(i, key=lambda r: r["sequence"]), r[0] if r else None, c) for n, (i, r, c) in found.items()}


PLAIN = ("evidence_id", "sequence", "vector", "valid_from", "valid_until", "observed_from", "valid_until_censored", "activation_event_id", "termination_event_id", "replacement_type", "superseded_by_evidence_id", "replaces_evidence_id", "timeline_status", "ambiguity_reason", "explicit_reversal", "readded_same_value", "inferred_initial_state", "chain_ambiguous", "first_observed_event_time")


@pytest.mark.parametrize("infer", [True, False])
def test_windows_equal_going_through_each_chain(spark, infer):
    chains = {n: random_chain(random.Random(n)) for n in range(1500)}
    met = set()
    for n, (rows, told, crossed) in replayed(spark, chains, infer).items():
        log = list(plain_replay.decide(chains[n], infer))
        met |= {a.other for a in log if a.name == "step"}
        head = {"chain_id": f"C||{n}"}
        want = plain_replay.intervals(head, log, 5)
        assert [{k: r[k] for k in PLAIN} for r in rows] == [{k: r[k] for k in PLAIN} for r in want], n
        report = plain_replay.report(head, log)
        assert {k: told[k] for k in report} == report, n
        assert sorted((c["removed_event_id"], c["added_event_id"], c["gap_days"], c["old_vector"], c["new_vector"]) for c in crossed) == sorted((c["removed_event_id"], c["added_event_id"], c["gap_days"], c["old_vector"], c["new_vector"]) for c in plain_replay.crossings(head, log)), n
    assert met == set(plain_replay.TABLE) - (set() if infer else {("removal", "first")})


def test_no_python_goes_through_a_chain(spark):
    events = spark.createDataFrame([("C", "3.1", "s", f"e{i}", f"c{i // 2}", i // 2 * DAY, "Added" if i % 2 else "Removed", "CVSS V3.1", "s", f"AV:{'NALP'[i * 7 % 4]}/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "x", "f", i, "CVE Modified", "p", "NIST") for i in range(3000)], "cve_id string, cvss_version string, source_key string, event_id string, change_id string, created_at long, action string, detail_type string, source_identifier_raw string, vector string, vector_raw string, source_file string, detail_index int, event_name string, change_pos string, source_prefix string")
    events = events.withColumn("vector_normalized", F.concat(F.lit("CVSS:3.1/"), "vector"))
    rows, told, _ = timeline.replay(events)
    assert told.first()["n_events"] == 3000 and not any(x in rows._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
    assert rows.count() > 1000


@pytest.mark.parametrize("infer", [True, False])
def test_what_holds_of_any_chain(spark, infer):
    chains = {seed: random_chain(random.Random(seed)) for seed in range(2000, 3000)}
    for seed, (rows, told, crossings) in replayed(spark, chains, infer).items():
        changes, start = chains[seed], len(f"C||{seed}|")
        events = {e["event_id"]: e for change in changes for e in change}
        kinds = {e["event_id"]: kind_of(change) for change in changes for e in change}
        order = {e: i for i, e in enumerate(events)}
        by_name = {r["evidence_id"]: r for r in rows}
        assert [r["evidence_id"] for r in rows] == [f"C||{seed}|{i + 1}" for i in range(len(rows))]

        # Beginnings: an added event of the value, one interval each; without one the interval is inferred and begins with the window.
        starts = [r["activation_event_id"] for r in rows if r["activation_event_id"]]
        assert len(set(starts)) == len(starts) and [order[s] for s in starts] == sorted(order[s] for s in starts)
        for r in rows:
            if r["activation_event_id"]:
                e = events[r["activation_event_id"]]
                assert (e["action"], e["vector"], e["created_at"]) == ("Added", r["vector"], r["valid_from"]) and r["observed_from"] == r["valid_from"]
            assert r["inferred_initial_state"] == r["valid_from_censored"] == (r["activation_event_id"] is None) == (r["inference_rule"] is not None)
            assert r["valid_from"] is not None or (r["valid_from"], r["observed_from"]) == (None, 5)

        # Ends: the removal of the value, or the addition of a strict pair that removes it; one interval each.
        ends = [r["termination_event_id"] for r in rows if r["termination_event_id"]]
        assert len(set(ends)) == len(ends)
        for r in rows:
            assert (r["valid_until"] is None) == (r["termination_event_id"] is None)
            if r["termination_event_id"]:
                e = events[r["termination_event_id"]]
                partner = [x for x in events.values() if x["change_id"] == e["change_id"] and x["action"] == "Removed" and x["vector"] == r["vector"]]
                assert e["created_at"] == r["valid_until"] and partner and (e["action"] == "Removed") == (kinds[e["event_id"]] == "loose")
                assert r["activation_event_id"] is None or order[r["activation_event_id"]] < order[e["event_id"]]
        held = [r["vector"] for r in rows if r["valid_until_censored"]]
        assert len(set(held)) == len(held) and all(r["valid_until"] is None for r in rows if r["valid_until_censored"])

        # Links: a strict pair links both ways, a crossing names the old interval alone; whoever is replaced says so.
        for r in rows:
            if r["superseded_by_evidence_id"]:
                after = by_name[r["superseded_by_evidence_id"]]
                assert r["replacement_type"] == replay.STRICT and after["replaces_evidence_id"] == r["evidence_id"] and after["activation_event_id"] == r["termination_event_id"]
            assert (r["replacement_type"] is not None) == (r["timeline_status"] == replay.REPLACED) and (r["replacement_type"] is None or r["valid_until"] is not None)
            if r["replaces_evidence_id"]:
                assert by_name[r["replaces_evidence_id"]]["replacement_type"] and int(r["replaces_evidence_id"][start:]) < r["sequence"]
            assert r["timeline_status"] != replay.WITHDRAWN or r["valid_until"] is not None
            assert r["timeline_status"] not in (replay.ACTIVE, replay.INITIAL) or r["valid_until"] is None
            earlier = any(x["vector"] == r["vector"] for x in rows[: r["sequence"] - 1])
            assert r["explicit_reversal"] == (earlier and not r["readded_same_value"] and not r["inferred_initial_state"]) and (earlier or not r["readded_same_value"])
        assert {(c["removed_event_id"], c["added_event_id"]) for c in crossings} == {(by_name[r["replaces_evidence_id"]]["termination_event_id"], r["activation_event_id"]) for r in rows if r["replaces_evidence_id"] and by_name[r["replaces_evidence_id"]]["replacement_type"] == replay.CROSS}
        assert all(c["gap_days"] > 0 and c["old_vector"] != c["new_vector"] for c in crossings)

        # Counts, from the list of events.
        whole = collections.Counter(kind_of(c) for c in changes)
        loose = collections.Counter(e["action"] for i, e in events.items() if kinds[i] == "loose")
        ended_loosely = sum(kinds[e] == "loose" for e in ends)
        begun_loosely = sum(kinds[s] != "strict" for s in starts)
        rewritten = sum(kinds[s] == "rewrite" for s in starts)
        one_each = sum(len(c) == 2 and len({e["action"] for e in c}) == 2 and kind_of(c) == "loose" for c in changes)
        assert told["n_events"] == len(events) and told["strict_pairs"] == whole["strict"] and told["rewrites"] == whole["rewrite"] and told["other_pairs"] == whole["rewrite"] + one_each
        assert told["unmatched_removed"] == loose["Removed"] - ended_loosely and told["duplicates"] == loose["Added"] - begun_loosely + rewritten
        assert told["crossings"] == len(crossings) and told["readds"] == sum(r["readded_same_value"] for r in rows) and told["reversals"] == sum(r["explicit_reversal"] for r in rows)
        first = bool(rows) and rows[0]["activation_event_id"] is not None and kinds[rows[0]["activation_event_id"]] != "strict"
        assert told["unmatched_added"] == begun_loosely - told["crossings"] - told["readds"] - first
        flat = list(events.values())
        assert told["same_time"] == sum(a["created_at"] == b["created_at"] and a["change_id"] != b["change_id"] for a, b in zip(flat, flat[1:]))

        # Reasons: each once, on every interval of the chain.
        why = told["reasons"]
        assert len(set(why)) == len(why) and all(set(r["ambiguity_reason"]) == set(why) and r["chain_ambiguous"] == bool(why) for r in rows)
        several = any({e["action"] for e in c} == {"Removed", "Added"} and len(c) > 2 for c in changes)
        assert (replay.SEVERAL in why) == several and (replay.PAST in why or replay.UNKNOWN in why) == (told["unmatched_removed"] > 0)
        assert (replay.COMPETING in why) == (told["competing"] > 0) and (replay.LOST not in why or whole["strict"] > 0)


def chain(*changes):
    """Changes from words like "1 -a +b": the day, and what is removed and added; "!" at the end makes a pair strict."""
    made = []
    for n, words in enumerate(changes):
        day, *acts = words.rstrip("!").split()
        strict = words.endswith("!")
        same = len(acts) == 2 and acts[0][1:] == acts[1][1:]
        made.append([{"action": "Added" if a[0] == "+" else "Removed", "vector": a[1:], "parseable": a[1:] != "bad", "parts": a[1:], "event_id": f"c{n}#{i}", "change_id": f"c{n}", "created_at": int(day) * DAY, "tier": "STRICT" if strict else "EXCLUDED" if same else "MODERATE",
                      "reasons": ["NO_METRIC_CHANGE"] if same else [], "detail_type": "T", "source_identifier_raw": "s", "vector_raw": a[1:], "source_file": "f"} for i, a in enumerate(acts)])
    return made


#: Chains, their intervals (value, first and last day, status, by which it is superseded, which it replaces), and the reasons.
KNOWN = {
    "a value that stays": (["1 +a"], [("a", 1, None, "INITIAL_ADDITION", None, None)], []),
    "a strict pair": (["1 +a", "4 -a +b!"], [("a", 1, 4, "REPLACED", 2, None), ("b", 4, None, "ACTIVE", None, 1)], []),
    "a strict pair first": (["4 -a +b!"], [("a", None, 4, "REPLACED", 2, None), ("b", 4, None, "ACTIVE", None, 1)], []),
    "a strict pair of a value that is not held": (["1 +c", "4 -a +b!"], [("c", 1, None, "INITIAL_ADDITION", None, None), ("a", None, 4, "REPLACED", 3, None), ("b", 4, None, "ACTIVE", None, 2)], [replay.LOST, replay.COMPETING]),
    "a removal first": (["3 -a"], [("a", None, 3, "WITHDRAWN_WITHOUT_REPLACEMENT", None, None)], []),
    "removed, later another one": (["1 +a", "2 -a", "9 +b"], [("a", 1, 2, "REPLACED", None, None), ("b", 9, None, "ACTIVE", None, 1)], []),
    "removed and another one at once": (["1 +a", "2 -a", "2 +b"], [("a", 1, 2, "WITHDRAWN_WITHOUT_REPLACEMENT", None, None), ("b", 2, None, "ACTIVE", None, None)], []),
    "removed, later one that is no vector": (["1 +a", "2 -a", "9 +bad"], [("a", 1, 2, "WITHDRAWN_WITHOUT_REPLACEMENT", None, None), ("bad", 9, None, "ACTIVE", None, None)], []),
    "removed and added again": (["1 +a", "2 -a", "9 +a"], [("a", 1, 2, "WITHDRAWN_WITHOUT_REPLACEMENT", None, None), ("a", 9, None, "ACTIVE", None, None)], []),
    "twice the same": (["1 +a", "2 +a"], [("a", 1, None, "INITIAL_ADDITION", None, None)], []),
    "a rewrite": (["1 +a", "2 -a +a"], [("a", 1, None, "INITIAL_ADDITION", None, None)], []),
    "two at a time": (["1 +a", "2 +b"], [("a", 1, None, "INITIAL_ADDITION", None, None), ("b", 2, None, "ACTIVE", None, None)], [replay.COMPETING]),
    "several in one change": (["1 +a", "2 -a +b +c"], [("a", 1, 2, "WITHDRAWN_WITHOUT_REPLACEMENT", None, None), ("b", 2, None, "ACTIVE", None, None), ("c", 2, None, "ACTIVE", None, None)], [replay.SEVERAL, replay.COMPETING]),
    "removals of what isn't held": (["1 +a", "2 -a", "3 -a", "4 -z"], [("a", 1, 2, "WITHDRAWN_WITHOUT_REPLACEMENT", None, None)], [replay.PAST, replay.UNKNOWN]),
}


def test_known_chains(spark):
    number = lambda x: int(x.rpartition("|")[2]) if x else None
    days = lambda t: None if t is None else t // DAY
    for name, (rows, told, _) in replayed(spark, {name: chain(*words) for name, (words, _, _) in KNOWN.items()}).items():
        _, want, reasons = KNOWN[name]
        assert [(r["vector"], days(r["valid_from"]), days(r["valid_until"]), r["timeline_status"], number(r["superseded_by_evidence_id"]), number(r["replaces_evidence_id"])) for r in rows] == want, name
        assert told["reasons"] == reasons, name


def test_a_removal_first_without_inference(spark):
    rows, told, _ = replayed(spark, {1: chain("3 -a")}, infer=False)[1]
    assert rows == [] and told["reasons"] == [replay.UNKNOWN]


def test_no_events(spark):
    assert [f.collect() for f in timeline.replay_paired(spark.createDataFrame([], EVENT))] == [[], [], []]
