"""Candidates are dealt once: what comes of them must not be shuffled, stored or looked up again, and must be the same as before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import learn, pit, profiles, quantiles
from palimpsest.plans import catalogue, checked, learned, ranked, summaries

#: Queries whose work is by question, by the finding that they failed by.
BY_QUESTION = [
    "bootstrap_generator", "capacity_groups", "chain_position_features", "label_profile", "lr_features", "metric_recall", "metric_stale", "metric_summary", "rule_corpus", "rule_diagnostics", "rule_target", "staleness_summary",
    "supersession_flagship", "suppressed_mass", "suppression_audit", "win_loss_tie", "metric_mrr", "impute_zscore", "learned_locked_run", "metric_ndcg", "metric_suppression", "cluster_sums", "paired_holm", "grouping_sets_report",
    "scope_comparison", "rule_direct", "list_gates", "offset_cohorts", "chain_newest_tiebreak", "oracle_current_first", "oracle_temporal", "recency_dev_selection", "recency_audit", "lr_train_eval", "lr_rerank_block",
]


@pytest.fixture
def plans(monkeypatch):
    """Plans and columns of all that is stored while a query is made; tables are not written but computed again."""
    seen = []

    def kept(frame, partitioned=False):
        seen.append(frame)
        return frame

    for module in (checked, learned, profiles, ranked, summaries):
        monkeypatch.setattr(module, "kept", kept)
    monkeypatch.setattr(ranked.stats, "bootstrap_by_generator", lambda sums, *a, **k: sums.withColumn("mean", F.lit(0.0)))
    monkeypatch.setattr(ranked.stats, "bootstrap_by_hash", lambda sums, *a, **k: sums.withColumns({"mean": F.lit(0.0), "replicate": F.lit(0)}))
    monkeypatch.setattr(learned.learn, "select_c", lambda train, dev, names, **k: (1.0, None, []))
    monkeypatch.setattr(learned.learn, "predict", lambda rows, model, names: rows.withColumn("p", F.lit(0.5)))
    monkeypatch.setattr(learned.learn, "fit_preparation", lambda train, numeric: {c: (0.0, 0.0, 1.0) for c in numeric})
    monkeypatch.setattr(learned.learn, "manifest_of", lambda *a, **k: {"preparation": {}, "weights": {}, "intercept": 0.0, "policy": "block", "alpha": None})
    monkeypatch.setattr(learned.learn, "lock", lambda *a: "")
    monkeypatch.setattr(learned.learn, "open_test", lambda spark, rows, path: (rows.where("role = 'test'"), {"preparation": {}, "weights": {}, "intercept": 0.0, "policy": "block", "alpha": None}))
    return seen


@pytest.mark.parametrize("name", BY_QUESTION)
def test_candidates_are_never_shuffled_by_question(spark, sf, plans, name):
    frame = catalogue.queries()[name](spark, sf)
    for each in [frame, *plans]:
        text = each._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line and "query_id" in line.split("hashpartitioning(")[1].split(")")[0]]
        assert not dealt, dealt
    assert not [f for f in plans if {"query_id", "evidence_id"} <= set(f.columns)]  # no whole pool is stored


def test_cells_hold_all_candidates_of_a_question(spark):
    rows = spark.createDataFrame([(e, f"e{e}_{i}", i) for e in range(5) for i in range(60 if e == 0 else 4)] + [(None, "none", 0)], "entity int, evidence_id string, o long")
    asked = spark.createDataFrame([(e, f"q{e}_{i}", i) for e in range(6) for i in range(0, 60 if e == 0 else 4)] + [(None, "qn", 9)], "entity int, query_id string, t long")
    pairs = rows.groupBy("entity").agg((F.count("*") * F.count("*")).alias("__pairs"))
    plain = sorted(map(tuple, pit.asof_join(asked, rows, ["entity"], "t", "o").select("query_id", "evidence_id").collect()))
    for most in (100, 10**9):
        cells = pit.asof_cells(asked, rows, ["entity"], "t", "o", pairs, most=most)
        assert sorted(map(tuple, cells.select("query_id", "evidence_id").collect())) == plain
        assert cells.groupBy("query_id").agg(F.count_distinct("cell").alias("n")).agg(F.max("n")).first()[0] == 1
        assert (cells.select("cell").distinct().count() > 1) == (most == 100)
    assert pit.asof_cells(asked, rows.limit(0), ["entity"], "t", "o", pairs.limit(0)).count() == 0


@pytest.fixture
def chains(spark):
    """Chains with ties of time, values that come again, and an empty and a missing value; questions that see some of each."""
    rng = np.random.default_rng(5)
    value = lambda: [None, "", "a", "b", "c"][rng.integers(0, 5)]
    rows = [(f"c{c}", int(rng.integers(0, 12)), f"c{c}_{i:02}", value()) for c in range(8) for i in range(12)]
    r = spark.createDataFrame(rows, "chain string, t long, id string, v string")
    q = spark.createDataFrame([(f"q{i}", i) for i in range(14)], "q string, at long")
    return r, r.join(q, r["t"] <= q["at"])


def test_what_follows_a_row_is_what_a_question_finds(chains):
    r, c = chains
    key = ["q", "id"]
    want = {(x["q"], x["id"]): x["witness"] for x in pit.first_witness(c, r, ["chain"], "t", "id", "v", "at", key).collect()}
    ahead = pit.witness_ahead(r, ["chain"], "t", "id", "v").select("id", "next_witness", "next_witness_at")
    got = {(x["q"], x["id"]): x["w"] for x in c.join(ahead, "id").select(*key, F.when(F.col("next_witness_at") <= F.col("at"), F.col("next_witness")).alias("w")).collect()}
    assert got == want and any(want.values())


def test_link_is_what_a_question_finds(chains):
    r, c = chains
    succ = F.concat(F.left("id", F.lit(3)), F.lpad(((F.right("id", F.lit(2)).cast("int") + 1) % 13).cast("string"), 2, "0"))
    r, c = r.withColumn("s", succ), c.withColumn("s", succ)
    want = {(x["q"], x["id"]): x["direct"] for x in pit.direct_link(c, r, F.col("s"), "id", "t", "at").collect()}
    ahead = pit.link_ahead(r, "s", "id", "t", ["chain"]).select("id", "next_direct_at")
    got = {(x["q"], x["id"]): x["d"] for x in c.join(ahead, "id").select("q", "id", F.coalesce(F.col("next_direct_at") <= F.col("at"), F.lit(False)).alias("d")).collect()}
    assert got == want and any(want.values())


def test_features_within_a_question_are_those_along_the_chain(chains):
    r, c = chains
    names = ["q", "id", "newer_count", "position", "days_to_newest", "differs_from_newest", "newest_id"]
    want = sorted(map(str, learn.chain_features(c, r, ["chain"], "t", "id", "v", "at", ["q", "id"]).select(*names).collect()))
    assert sorted(map(str, learn.chain_features_within(c, ["q"], ["chain"], "t", "id", "v").select(*names).collect())) == want


@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(3)
    columns = {"skewed": np.exp(rng.normal(0, 30, 501)), "ties": rng.integers(0, 3, 501).astype(float), "even": rng.normal(size=501), "one": np.full(501, 2.5), "ends": np.where(rng.random(501) < 0.6, np.inf, -np.inf)}
    columns["even"][7] = np.nan
    rows = [tuple(None if c == "even" and i == 9 else float(v[i]) for c, v in columns.items()) + (None,) for i in range(501)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "nothing"]))
    for p in (0.5, 0.1, 0.0, 1.0):
        got = quantiles.interpolated(frame, [*columns, "nothing"], p)
        want = frame.select(*[F.percentile(F.nullif(c, F.lit(float("nan"))), F.lit(p)).alias(c) for c in got]).first().asDict() if p else None
        for c, x in got.items():
            v = np.array([r[list(got).index(c)] for r in rows], dtype=float)
            v = np.sort(v[~np.isnan(v)])
            expected = None if not len(v) else want[c] if want else v[0]
            assert x == expected or x == pytest.approx(expected, rel=1e-12), (c, p)
