"""Rankings by hash alone hand on the best of each block, not all pairs."""

import hashlib

import pytest

from palimpsest.operators import retrieval
from palimpsest.plans import catalogue


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_ranking_by_hash(spark, block):
    ids, asked = [f"{i}" for i in range(40)], ["a", "b", "c"]
    d, q = spark.createDataFrame([(i,) for i in ids], "evidence_id string"), spark.createDataFrame([(i,) for i in asked], "query_id string")
    key = lambda q, i: hashlib.sha256(f"5|{q}|{i}".encode()).hexdigest()
    want = sorted((q, i, n) for q in asked for n, i in enumerate(sorted(ids, key=lambda i: key(q, i))[:6], 1))
    found = retrieval.by_hash(d, q, 6, 5, block=block, questions=2)
    assert sorted(map(tuple, found.select("query_id", "evidence_id", "rank").collect())) == want
    assert retrieval.by_hash(d.limit(0), q, 6, 5).count() == 0


def test_fusion_makes_no_table_of_all_pairs(spark, sf):
    assert not [line for line in plan_of(catalogue.queries()["rrf_fusion"](spark, sf)) if "NestedLoopJoin" in line or "CartesianProduct" in line]
