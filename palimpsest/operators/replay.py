"""Replay of chains by window functions.

A chain's changes are cut into steps, and a step into the touches of the values that it takes away or brings. What a step meets
can be told without going through the chain: a value is held if the last touch of it before brought it, was seen if any touch began an
interval, and the removal that an addition may follow is the last one since anything else happened. So a chain is sorted and passed by
windows, which spill, and no task holds a chain's log, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import DAY

#: Statuses of an interval, kinds of replacement, and the rule of inference.
INITIAL, ACTIVE, REPLACED, WITHDRAWN = "INITIAL_ADDITION", "ACTIVE", "REPLACED", "WITHDRAWN_WITHOUT_REPLACEMENT"
STRICT, CROSS = "STRICT_SAME_CHANGE", "HIGH_CONFIDENCE_CROSS_EVENT"
FIRST_REMOVAL = "FIRST_OBSERVED_EVENT_IS_REMOVAL"
#: Reasons that make a chain ambiguous.
COMPETING, SEVERAL, LOST, PAST, UNKNOWN = (
    "MULTIPLE_COMPETING_ACTIVE_VALUES",
    "MULTI_REMOVED_OR_ADDED_IN_ONE_CHANGE",
    "STRICT_PAIR_OLD_VALUE_NOT_ACTIVE",
    "REMOVAL_OF_INACTIVE_VALUE",
    "REMOVAL_OF_UNOBSERVED_VALUE_AFTER_OTHER_EVENTS",
)
CHAIN = ["cve_id", "cvss_version", "source_key"]
_EVENT = ["event_id", "created_at", "vector", "parseable", "parts", "detail_type", "source_identifier_raw", "vector_raw", "source_file"]


def steps(events: DataFrame) -> DataFrame:
    """A row for each step: k (its place in the chain), kind, gone and came (events), events_upto (of the chain, to the end of its change).

    A strict pair and a rewrite have both events; a removal only what is gone, an addition only what came. Of other changes with several
    events the removals come first. ``events``: as of ``timeline.paired``.
    """
    change = Window.partitionBy(*CHAIN, "change_id")
    in_order = Window.partitionBy(*CHAIN).orderBy("began", "created_at", "detail_index")
    is_ = lambda action: F.col("action") == action
    event = F.struct(*_EVENT)
    only = lambda action: F.max(F.when(is_(action), event)).over(change)
    told = events.withColumns(
        {
            "r": F.count_if(is_("Removed")).over(change), "a": F.count_if(is_("Added")).over(change), "g": only("Removed"), "c": only("Added"),
            "same": ((F.lag("created_at").over(in_order) == F.col("created_at")) & (F.lag("change_id").over(in_order) != F.col("change_id"))).cast("int"),
            "events_upto": F.count("*").over(Window.partitionBy(*CHAIN).orderBy("began")),
        }
    )
    one = (F.col("r") == 1) & (F.col("a") == 1)
    unchanged = F.array_contains(F.coalesce("reasons", F.array().cast("array<string>")), "NO_METRIC_CHANGE") & (F.col("g.vector") == F.col("c.vector"))
    kind = F.when(one & (F.col("tier") == "STRICT"), "strict").when(one & unchanged, "rewrite").when(is_("Removed"), "removal").otherwise("addition")
    told = told.withColumn("kind", kind).withColumn("pair", F.col("kind").isin("strict", "rewrite"))
    told = told.withColumn("same_time", F.when(F.col("pair"), F.sum("same").over(change)).otherwise(F.col("same")))
    kept = told.where(~F.col("pair") | is_("Added"))
    mixed = (F.col("r") > 0) & (F.col("a") > 0)
    return kept.select(
        *CHAIN, "kind", F.when(F.col("pair"), F.col("g")).when(is_("Removed"), event).alias("gone"), F.when(is_("Added"), event).alias("came"), "events_upto", F.coalesce("same_time", F.lit(0)).alias("same_time"),
        (mixed & ~one).alias("several"), (mixed & one & ~F.col("pair")).alias("loose_pair"),
        F.row_number().over(Window.partitionBy(*CHAIN).orderBy("began", is_("Added"), "created_at", "detail_index")).alias("k"),
    )


def touches(steps: DataFrame, infer: bool = True) -> DataFrame:
    """A row for each value that a step takes away (side 0) or brings (side 1), with what it meets and what follows.

    held and seen tell of the value before the touch, n_before of the chain; begins, inferred and ends what the touch does, no the number of
    intervals up to it and own_no the interval of its value. added is what an addition is; of a crossing, last_end is the removal that it follows.
    """
    side = lambda on, event: F.struct(F.lit(on).alias("side"), F.col(event).alias("e"))
    sides = F.when(F.col("kind") == "strict", F.array(side(0, "gone"), side(1, "came"))).when(F.col("kind") == "removal", F.array(side(0, "gone"))).otherwise(F.array(side(1, "came")))
    each = steps.select("*", F.inline(sides)).withColumn("value", F.col("e.vector"))
    is_ = lambda kind: F.col("kind") == kind
    on = F.col("side") == 1
    of_value = Window.partitionBy(*CHAIN, "value").orderBy("k", "side")
    of_chain = Window.partitionBy(*CHAIN).orderBy("k", "side")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    first = is_("removal") & (F.col("events_upto") == 1) & F.lit(infer)
    each = each.withColumns({"held": F.coalesce(F.lag(on).over(of_value), F.lit(False)), "seen": F.coalesce(F.max(on | is_("strict") | first).over(before(of_value)), F.lit(False))})
    each = each.withColumns({"begins": F.when(is_("strict"), on | ~F.col("held")).when(is_("removal"), first).otherwise(~F.col("held")), "ends": ~on & (is_("strict") | F.col("held") | first)})
    change = F.when(on & ~F.col("held"), 1).when(~on & F.col("held"), -1).otherwise(0)
    each = each.withColumns({"no": F.sum(F.col("begins").cast("int")).over(upto(of_chain)).cast("int"), "n_held": F.sum(change).over(upto(of_chain))})
    each = each.withColumns({"n_before": F.col("no") - F.col("begins").cast("int"), "own_no": F.last(F.when(F.col("begins"), F.col("no")), ignorenulls=True).over(upto(of_value))})
    ended = F.when(is_("removal") & F.col("ends"), F.struct("k", F.col("own_no").alias("no"), "e"))
    each = each.withColumns({"last_end": F.last(ended, ignorenulls=True).over(before(of_chain)), "last_other": F.max(F.when(~is_("removal"), F.col("k"))).over(before(of_chain)), "gone_no": F.lag("own_no").over(of_chain)})
    each = each.withColumn("inferred", F.col("begins") & (~on | (is_("rewrite") & (F.col("n_before") == 0) & (F.col("events_upto") <= 2))))
    follows = F.col("last_end.k") > F.coalesce("last_other", F.lit(0))
    old = F.col("last_end.e")
    crosses = old["parseable"] & F.col("e.parseable") & (old["parts"] != F.col("e.parts")) & (old["created_at"] < F.col("e.created_at"))
    added = F.when(follows & (old["vector"] == F.col("value")), "again").when(follows & crosses, "crossing").when(F.col("n_before") > 0, "later").otherwise("initial")
    each = each.withColumn("added", F.when(F.col("begins") & ~F.col("inferred") & ~is_("strict"), added))
    compete = ((is_("strict") & on) | (F.coalesce("added", F.lit("")) == "later")) & (F.col("n_held") > 1)
    each = each.withColumn("compete", compete).withColumn("competed", F.coalesce(F.sum(F.col("compete").cast("int")).over(before(of_chain)), F.lit(0)))
    lost = is_("strict") & ~on & F.col("begins") & ~((F.col("n_before") == 0) & (F.col("events_upto") == 2))
    unmatched = is_("removal") & ~F.col("ends")
    return each.withColumns({"lost": lost, "unmatched": unmatched, "reversal": F.col("begins") & ~F.col("inferred") & F.col("seen") & (F.coalesce("added", F.lit("")) != "again")})


def _reasons() -> Column:
    """Why a chain is ambiguous, in the order in which it came up: the places of a step's reasons are told apart by quarters."""
    whole = Window.partitionBy(*CHAIN)
    places = ((SEVERAL, F.col("several"), 0), (LOST, F.col("lost"), 1), (PAST, F.col("unmatched") & F.col("seen"), 1), (UNKNOWN, F.col("unmatched") & ~F.col("seen"), 1), (COMPETING, F.col("compete"), 2))
    found = [F.struct(F.min(F.when(test, 4 * F.col("k") + quarter)).over(whole).alias("at"), F.lit(name).alias("name")) for name, test, quarter in places]
    return F.transform(F.array_sort(F.filter(F.array(*found), lambda x: x["at"].isNotNull())), lambda x: x["name"])


def named(touched: DataFrame) -> DataFrame:
    """The touches with chain_id and the chain's reasons."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return touched.withColumns({"chain_id": F.concat_ws("|", *map(text, CHAIN)), "reasons": _reasons()})


def crossings(touched: DataFrame) -> DataFrame:
    """Replacements of a value by another one in a later change, with the numbers of both intervals (old_no and new_no)."""
    t = touched.where("added = 'crossing'")
    gap = F.round((F.col("e.created_at") - F.col("last_end.e.created_at")) / DAY, 3)
    return t.select(
        "chain_id", *CHAIN, F.col("last_end.e.event_id").alias("removed_event_id"), F.col("e.event_id").alias("added_event_id"), F.col("last_end.e.created_at").alias("removed_at"), F.col("e.created_at").alias("added_at"),
        gap.alias("gap_days"), F.col("last_end.e.vector").alias("old_vector"), F.col("value").alias("new_vector"), F.col("last_end.no").alias("old_no"), F.col("no").alias("new_no"),
    )


def reports(touched: DataFrame) -> DataFrame:
    """How often what happened in each chain."""
    done = (F.col("side") == 1) | (F.col("kind") == "removal")  # the last touch of a step
    is_ = lambda kind: done & (F.col("kind") == kind)
    added = lambda what: F.coalesce(F.col("added") == what, F.lit(False))
    counts = {
        "strict_pairs": is_("strict"), "other_pairs": is_("rewrite") | (is_("removal") & F.col("loose_pair")), "rewrites": is_("rewrite"), "duplicates": is_("addition") & ~F.col("begins"), "readds": added("again"), "crossings": added("crossing"),
        "reversals": F.col("reversal"), "unmatched_removed": F.col("unmatched"), "unmatched_added": added("later"), "competing": F.col("compete"),
    }
    own = [F.count_if(test).cast("int").alias(name) for name, test in counts.items()]
    return touched.groupBy("chain_id", *CHAIN).agg(F.first("reasons").alias("reasons"), F.max("events_upto").cast("int").alias("n_events"), *own, F.sum(F.when(done, F.col("same_time"))).cast("int").alias("same_time")).withColumn("ambiguous", F.size("reasons") > 0)


def intervals(touched: DataFrame, window_start: int) -> DataFrame:
    """One row for each interval, in the order of its beginning within the chain."""
    back = Window.partitionBy(*CHAIN, "value").orderBy(F.desc("k"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    strict = F.col("kind") == "strict"
    # What ends an interval, or takes its value over without ending it.
    this = F.struct("side", (~F.col("begins") | (F.col("side") == 0)).alias("ends"), strict.alias("strict"), F.when(strict, F.col("came")).otherwise(F.col("gone")).alias("e"), (F.col("no") + 1).alias("next_no"), "competed")
    later = F.last(F.when((F.col("side") == 0) | F.col("begins"), this), ignorenulls=True).over(back)
    rows = touched.withColumns({"after": F.when(F.col("side") == 0, this).otherwise(later), "all_competed": F.sum(F.col("compete").cast("int")).over(Window.partitionBy(*CHAIN))}).where("begins")
    rows = rows.withColumns({"end": F.when(F.col("after.side") == 0, F.col("after")), "open": F.col("after").isNull(), "from": F.when((F.col("kind") == "rewrite") & F.col("inferred"), F.col("gone")).otherwise(F.col("e"))})
    met = crossings(touched)
    rows = rows.join(met.select(*CHAIN, F.col("old_no").alias("no"), F.col("new_vector").alias("crossed_by")), [*CHAIN, "no"], "left")
    name = lambda c: F.when(c.isNotNull(), F.concat_ws("|", "chain_id", c))
    known, superseded, crossed, initial = ~F.col("inferred"), F.coalesce(F.col("end.strict"), F.lit(False)), F.col("crossed_by").isNotNull(), F.coalesce(F.col("added") == "initial", F.lit(False))
    replaces = F.when(strict & (F.col("side") == 1), F.col("gone_no")).when(F.col("added") == "crossing", F.col("last_end.no"))
    rival = (F.col("side") == 1) & (F.when(F.col("open"), F.col("all_competed")).otherwise(F.col("after.competed")) > F.col("competed"))
    none = F.array().cast("array<string>")
    at = F.col("from.created_at")
    return rows.select(
        name(F.col("no")).alias("evidence_id"), "chain_id", *CHAIN, F.col("no").alias("sequence"), F.col("from.detail_type").alias("detail_type"), F.col("from.source_identifier_raw").alias("source_identifier_raw"), F.col("from.vector").alias("vector"),
        F.col("from.vector_raw").alias("vector_raw"), F.col("from.source_file").alias("source_file"), at.alias("first_observed_event_time"), F.when(known, at).alias("valid_from"), F.col("inferred").alias("valid_from_censored"),
        F.when(known, at).otherwise(F.lit(window_start)).alias("observed_from"), F.col("end.e.created_at").alias("valid_until"), F.col("open").alias("valid_until_censored"), F.when(known, F.col("from.event_id")).alias("activation_event_id"),
        F.col("end.e.event_id").alias("termination_event_id"), F.when(superseded, STRICT).when(crossed, CROSS).alias("replacement_type"), name(F.when(superseded, F.col("end.next_no"))).alias("superseded_by_evidence_id"), name(replaces).alias("replaces_evidence_id"),
        F.when(superseded | crossed, REPLACED).when(F.col("end").isNotNull(), WITHDRAWN).when(initial, INITIAL).otherwise(ACTIVE).alias("timeline_status"),
        F.concat(F.when(rival, F.array(F.lit(COMPETING))).otherwise(none), F.filter("reasons", lambda x: ~rival | (x != COMPETING))).alias("ambiguity_reason"),
        F.col("inferred").alias("inferred_initial_state"), F.when(~known, FIRST_REMOVAL).alias("inference_rule"), F.col("reversal").alias("explicit_reversal"), F.coalesce(F.col("added") == "again", F.lit(False)).alias("readded_same_value"),
        F.when(superseded, F.col("end.e.vector")).otherwise(F.col("crossed_by")).alias("replaced_with"), (F.size("reasons") > 0).alias("chain_ambiguous"),
    )
