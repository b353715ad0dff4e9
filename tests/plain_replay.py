"""Replay of one chain in plain Python, which the windows of ``operators.replay`` are compared with: a table of transitions decides, a log of acts is kept, rows are read off the log.

A chain's changes are cut into steps. What a step meets is its situation; TABLE says which acts follow. Acts change the
few things a chain has to remember and go to the log; nothing in the log is ever changed. Intervals, the report and
cross-event replacements are views of a finished log.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from palimpsest.config import DAY
from palimpsest.operators.replay import ACTIVE, COMPETING, CROSS, FIRST_REMOVAL, INITIAL, LOST, PAST, REPLACED, SEVERAL, STRICT, UNKNOWN, WITHDRAWN

class Step(NamedTuple):
    """strict and rewrite have both events, removal only what is gone, addition only what came."""

    kind: str
    gone: dict | None
    came: dict | None


class Act(NamedTuple):
    """An entry of the log: on which interval (by its number from 1), by which event, with what besides."""

    name: str
    interval: int
    event: dict | None = None
    other: object = None


#: (kind of step, situation) to acts, in order. Situations: the value is held; nothing was there before this change (first); no
#: interval holds it although one should (lost); it was held once (past) or never (unknown). Of additions: the value that was just
#: removed comes again, another one crosses over to it, the chain begins, or it comes later than something else.
TABLE: dict[tuple[str, str], tuple[str, ...]] = {
    ("strict", "held"): ("replace", "compete"),
    ("strict", "first"): ("infer", "replace", "compete"),
    ("strict", "lost"): ("infer", LOST, "replace", "compete"),
    ("rewrite", "held"): (),
    ("rewrite", "first"): ("infer",),
    ("rewrite", "lost"): ("as addition",),
    ("removal", "held"): ("end",),
    ("removal", "first"): ("infer", "end"),
    ("removal", "past"): (PAST,),
    ("removal", "unknown"): (UNKNOWN,),
    ("addition", "held"): (),
    ("addition", "again"): ("begin again",),
    ("addition", "crossing"): ("begin", "cross"),
    ("addition", "initial"): ("begin",),
    ("addition", "later"): ("begin", "compete"),
}


def steps(change: list[dict]) -> list[Step]:
    """The steps of one change: a pair, or all removals and then all additions."""
    gone, came = ([e for e in change if e["action"] == a] for a in ("Removed", "Added"))
    if len(gone) == len(came) == 1:
        old, new = gone[0], came[0]
        if new["tier"] == "STRICT":
            return [Step("strict", old, new)]
        if "NO_METRIC_CHANGE" in new["reasons"] and old["vector"] == new["vector"]:
            return [Step("rewrite", old, new)]
    return [Step("removal", e, None) for e in gone] + [Step("addition", None, e) for e in came]


def decide(changes: Iterable[list[dict]], infer: bool = True) -> Iterator[Act]:
    """The log of a chain, from its changes in order."""
    held: dict[str, int] = {}  # value to the interval that holds it
    seen: set[str] = set()
    begun: list[dict] = []  # the events that began the intervals
    ended = None  # (interval, event) of a removal, until the next addition or pair
    events = 0
    before = None

    def situation(step: Step) -> str:
        value = (step.gone or step.came)["vector"]
        if value in held:
            return "held"
        nothing = not held and not seen
        match step.kind:
            case "strict":
                return "first" if nothing and events == 2 else "lost"
            case "rewrite":
                return "first" if nothing and events <= 2 else "lost"
            case "removal":
                return "first" if nothing and events == 1 and infer else "past" if value in seen else "unknown"
        if ended:
            old, end = begun[ended[0] - 1], ended[1]
            if old["vector"] == value:
                return "again"
            if old["parseable"] and step.came["parseable"] and old["parts"] != step.came["parts"] and end["created_at"] < step.came["created_at"]:
                return "crossing"
        return "later" if begun else "initial"

    def begin(event: dict, name: str, other: object = None) -> Act:
        begun.append(event)
        seen.add(event["vector"])
        held[event["vector"]] = len(begun)
        return Act(name, len(begun), event, other)

    def perform(step: Step, told: str) -> Iterator[Act]:
        nonlocal ended
        for name in TABLE[step.kind, told]:
            match name:
                case "infer":
                    yield begin(step.gone, "infer")
                case "end":
                    ended = held.pop(step.gone["vector"]), step.gone
                    yield Act("end", *ended)
                case "replace":
                    old = held.pop(step.gone["vector"])
                    yield Act("end", old, step.came)
                    yield begin(step.came, "begin", {"back": step.came["vector"] in seen, "initial": False})
                    yield Act("supersede", old, step.came, len(begun))
                case "begin":
                    yield begin(step.came, "begin", {"back": step.came["vector"] in seen, "initial": told == "initial"})
                case "begin again":
                    yield begin(step.came, "begin again")
                case "cross":
                    yield Act("cross", ended[0], step.came, (len(begun), ended[1]))
                case "compete":
                    if len(held) > 1:
                        yield Act("compete", 0, None, list(held.values()))
                case "as addition":
                    addition = Step("addition", None, step.came)
                    yield from take(addition)
                case reason:
                    yield Act("blame", 0, None, reason)
        if step.kind != "removal":
            ended = None

    def take(step: Step) -> Iterator[Act]:
        told = situation(step)
        yield Act("step", 0, None, (step.kind, told))
        yield from perform(step, told)

    for change in changes:
        for e in change:
            if before and before["created_at"] == e["created_at"] and before["change_id"] != e["change_id"]:
                yield Act("same time", 0)
            before = e
        events += len(change)
        made = steps(change)
        kinds = {s.kind for s in made}
        if kinds == {"removal", "addition"}:
            yield Act("pair", 0) if len(made) == 2 else Act("blame", 0, None, SEVERAL)
        for step in made:
            yield from take(step)
    yield Act("close", 0, None, (events, set(held.values())))


def reasons_of(log: list[Act]) -> list[str]:
    """Why a chain is ambiguous, each reason once, in the order in which they came up."""
    found = (a.other if a.name == "blame" else COMPETING for a in log if a.name in ("blame", "compete"))
    return list(dict.fromkeys(found))


def intervals(head: dict, log: list[Act], window_start: int) -> list[dict]:
    """One row for each interval of a finished log."""
    reasons = reasons_of(log)
    rivals = {i for a in log if a.name == "compete" for i in a.other}
    ends = {a.interval: a.event for a in log if a.name == "end"}
    fates = {a.interval: a for a in log if a.name in ("supersede", "cross")}
    replaces = {a.other if a.name == "supersede" else a.other[0]: a.interval for a in fates.values()}
    _, open_ = log[-1].other
    name = lambda i: f"{head['chain_id']}|{i}" if i else None
    rows = []
    for a in log:
        if a.name not in ("infer", "begin", "begin again"):
            continue
        i, e, end, fate = a.interval, a.event, ends.get(a.interval), fates.get(a.interval)
        known = a.name != "infer"
        initial = a.name == "begin" and a.other["initial"]
        status = REPLACED if fate else WITHDRAWN if end else INITIAL if initial else ACTIVE
        own = [COMPETING] if i in rivals else []
        rows.append(
            head
            | {k: e[k] for k in ("detail_type", "source_identifier_raw", "vector", "vector_raw", "source_file")}
            | {
                "evidence_id": name(i),
                "sequence": i,
                "first_observed_event_time": e["created_at"],
                "valid_from": e["created_at"] if known else None,
                "valid_from_censored": not known,
                "observed_from": e["created_at"] if known else window_start,
                "valid_until": end["created_at"] if end else None,
                "valid_until_censored": i in open_,
                "activation_event_id": e["event_id"] if known else None,
                "termination_event_id": end["event_id"] if end else None,
                "replacement_type": None if not fate else STRICT if fate.name == "supersede" else CROSS,
                "superseded_by_evidence_id": name(fate.other) if fate and fate.name == "supersede" else None,
                "replaces_evidence_id": name(replaces.get(i)),
                "timeline_status": status,
                "ambiguity_reason": own + [r for r in reasons if r not in own],
                "inferred_initial_state": not known,
                "inference_rule": None if known else FIRST_REMOVAL,
                "explicit_reversal": a.name == "begin" and a.other["back"],
                "readded_same_value": a.name == "begin again",
                "replaced_with": fate.event["vector"] if fate else None,
                "chain_ambiguous": bool(reasons),
            }
        )
    return rows


def report(head: dict, log: list[Act]) -> dict:
    """How often what happened in a chain."""
    taken = Counter(a.other for a in log if a.name == "step")
    kinds = Counter(kind for kind, _ in taken.elements())
    acts = Counter(a.name for a in log)
    events, _ = log[-1].other
    return head | {
        "reasons": reasons_of(log),
        "n_events": events,
        "strict_pairs": kinds["strict"],
        "other_pairs": kinds["rewrite"] + acts["pair"],
        "rewrites": kinds["rewrite"],
        "duplicates": taken["addition", "held"],
        "readds": taken["addition", "again"],
        "crossings": taken["addition", "crossing"],
        "reversals": sum(a.name == "begin" and a.other["back"] for a in log),
        "unmatched_removed": taken["removal", "past"] + taken["removal", "unknown"],
        "unmatched_added": taken["addition", "later"],
        "competing": acts["compete"],
        "same_time": acts["same time"],
    }


def crossings(head: dict, log: list[Act]) -> list[dict]:
    """Replacements of a value by another one in a later change."""
    begun = {a.interval: a.event for a in log if a.name in ("infer", "begin", "begin again")}
    rows = []
    for a in log:
        if a.name == "cross":
            _, end = a.other
            rows.append(
                head
                | {
                    "removed_event_id": end["event_id"],
                    "added_event_id": a.event["event_id"],
                    "removed_at": end["created_at"],
                    "added_at": a.event["created_at"],
                    "gap_days": round((a.event["created_at"] - end["created_at"]) / DAY, 3),
                    "old_vector": begun[a.interval]["vector"],
                    "new_vector": a.event["vector"],
                }
            )
    return rows
