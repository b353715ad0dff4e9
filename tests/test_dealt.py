"""Chains are made where their assertions are dealt: one shuffle of plain assertions is all that candidates cost, whatever follows the intervals."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import pit
from palimpsest.plans import catalogue
from palimpsest.sources import adapters as A
from tests.test_scale import plans  # noqa: F401

#: Queries over candidates, by the finding that they failed by.
ONCE = [
    "metric_recall", "suppressed_mass", "label_profile", "suppression_audit", "capacity_groups", "chain_position_features", "lr_features", "metric_stale", "metric_summary", "rule_corpus", "supersession_flagship",
    "win_loss_tie", "metric_mrr", "impute_zscore", "learned_locked_run", "metric_ndcg", "metric_suppression", "cluster_sums", "paired_holm", "grouping_sets_report", "scope_comparison", "rule_direct", "list_gates",
    "offset_cohorts", "chain_newest_tiebreak", "oracle_current_first", "oracle_temporal", "recency_dev_selection", "recency_audit",
]


#: Of these, queries whose condition on the entity reaches one side of the join alone: each side has its own shuffle.
ONE_SIDED = ("learned_locked_run", "recency_dev_selection")


def shuffles(frame):
    """The shuffles of a plan, without those that adaptive execution will reuse."""
    plan, found = frame._jdf.queryExecution().executedPlan().initialPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange" and not any(node.sameResult(x) for x in found):
            found.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return [x.toString().split("\n")[0] for x in found]


@pytest.mark.parametrize("name", ONCE)
def test_only_plain_assertions_are_shuffled(spark, sf, plans, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(pit, "TASK_PAIRS", 2_000)
    frame = catalogue.queries()[name](spark, sf)
    for each in [frame, *plans]:
        by = [x.split("hashpartitioning(")[1].split("#")[0] + " " + x for x in shuffles(each) if "hashpartitioning(" in x]
        whole = [x for x in by if x.startswith("entity ") and ("cell#" in x or "source#" in x)]
        assert 1 <= len(whole) <= (2 if name in ONE_SIDED else 1) and all("REPARTITION_BY_NUM" in x for x in whole), whole
        assert not [x for x in by if x not in whole and ("valid_from#" in x or "e_source#" in x or "replaced_by#" in x)], by


@pytest.mark.parametrize("name", ONE_SIDED)
def test_condition_on_the_entity_holds_before_assertions_are_dealt(spark, sf, plans, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(pit, "TASK_PAIRS", 2_000)
    frame = catalogue.queries()[name](spark, sf)
    for each in [frame, *plans]:
        assert len([x for x in shuffles(each) if "hashpartitioning(entity#" in x and "cell#" in x]) == 1


@pytest.mark.parametrize("most", [60, 10**9])
def test_candidates_of_some_entities_are_those_of_all(spark, sf, monkeypatch, most):
    monkeypatch.setattr(pit.deal, "__defaults__", (most,))
    only = F.col("entity") % 3 == 1
    names = ["query_id", "evidence_id", "class", "old_id", "new_id", "replaced_by", "value", "rank"]
    assert sorted(map(str, A.pool(spark, sf, only=only).select(*names).collect())) == sorted(map(str, A.pool(spark, sf).where(only).select(*names).collect()))


@pytest.mark.parametrize("name", ["suppression_audit", "suppressed_mass"])
def test_evidence_is_counted_where_it_lies(spark, sf, monkeypatch, name):
    """What leaves a cell has the name of its evidence only if the entity has several cells."""
    monkeypatch.setattr(pit, "TASK_PAIRS", 2_000)
    named = [x for x in shuffles(catalogue.queries()[name](spark, sf)) if "evidence_id#" in x]
    assert not named
    plain = sorted(map(str, catalogue.queries()[name](spark, sf).collect()))
    monkeypatch.setattr(pit.deal, "__defaults__", (60,))
    assert sorted(map(str, catalogue.queries()[name](spark, sf).collect())) == plain


def test_evidence_of_a_profile_is_shuffled_once(spark, sf, plans):  # noqa: F811
    frame = catalogue.queries()["label_profile"](spark, sf)
    assert len({x.split("[plan_id")[0] for x in shuffles(frame) if "evidence_id#" in x}) <= 1
    assert {"n", "classes", "m"} in [set(x.columns) for x in plans]


@pytest.mark.parametrize("most", [60, 10**9])
def test_dealt_candidates_are_those_of_plain_intervals(spark, sf, monkeypatch, most):
    names = ["query_id", "evidence_id", "class", "old_id", "new_id", "replaced_by", "value"]
    plain = sorted(map(str, A.candidates(spark, sf, A.intervals(spark, sf)).select(*names).collect()))
    monkeypatch.setattr(pit.deal, "__defaults__", (most,))
    dealt = A.candidates(spark, sf)
    assert sorted(map(str, dealt.select(*names).collect())) == plain
    assert dealt.groupBy("query_id").agg(F.count_distinct("cell").alias("n")).agg(F.max("n")).first()[0] == 1
    assert (dealt.agg(F.count_distinct(F.pmod("cell", F.lit(pit.CELLS)))).first()[0] > 1) == (most == 60)


def test_links_and_witnesses_of_dealt_rows(spark):
    """Rows without a chain, a successor or a time, and names that come twice, as a join would have it."""
    rows = [("a", 1, "x", "y", "1"), ("a", 2, "y", "z", "2"), ("a", 2, "y", None, "1"), ("a", None, "z", "x", "2"), ("b", 5, "x", "nowhere", ""), (None, 1, "x", "y", "1"), (None, 2, "y", "x", "2")]
    r = spark.createDataFrame(rows, "chain string, t long, id string, s string, v string")
    want = sorted(map(str, pit.link_to(r, r, "s", "id", "t", ["chain"]).collect()))
    assert sorted(map(str, pit.link_ahead(r, "s", "id", "t", ["chain"]).collect())) == want
    asked = r.withColumn("at", F.lit(9).cast("long"))
    found = pit.first_witness(asked, r, ["chain"], "t", "id", "v", "at", ["id"])
    ahead = pit.witness_ahead(r, ["chain"], "t", "id", "v")
    assert sorted(map(str, ahead.select(*r.columns, F.col("next_witness").alias("witness")).collect())) == sorted(map(str, found.select(*r.columns, "witness").collect()))
