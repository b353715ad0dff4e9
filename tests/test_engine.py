"""Labels, splits, retrieval, ranking, metrics, statistics and learning on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Splits, Statistics
from palimpsest.operators import corpus, diagnostics, evaluate, gates, learn, pit, ranking, retrieval, splits, stats
from palimpsest.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize(
    "seen,amb,on,active,strict,want",
    [(False, True, True, True, True, "NOT_VISIBLE"), (True, True, True, True, True, "EXCLUDED_AMBIGUOUS"), (True, False, False, True, True, "NOT_TARGET_CHAIN"), (True, False, True, True, True, "CURRENT"), (True, False, True, False, True, "OUTDATED"), (True, False, True, False, False, "NOT_LABELABLE"), (True, False, True, False, None, "NOT_LABELABLE")],
)
def test_labels(spark, seen, amb, on, active, strict, want):
    lit = lambda x: F.lit(x).cast("boolean")
    assert spark.range(1).select(pit.label(lit(seen), lit(amb), lit(on), lit(active), lit(strict))).first()[0] == want


def test_half_open_intervals_and_wildcards(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (9, None)], "obs long, until long")
    assert [df.where(pit.active(F.col("obs"), F.col("until"), F.lit(t))).count() for t in (0, 1, 4, 5, 9)] == [0, 2, 2, 1, 2]
    assert spark.range(1).select(pit.target_chain(F.lit(None).cast("string"), F.lit("s"), F.lit("3.1"), F.lit("c"), F.lit("s"), F.lit(None).cast("string"))).first()[0] is True


def test_asof_count_equals_bisection(spark):
    import bisect

    rng = random.Random(1)
    obs = sorted(rng.randrange(0, 10 * pit.DAY) for _ in range(300))
    at = [rng.randrange(-pit.DAY, 11 * pit.DAY) for _ in range(80)] + obs[:20]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(at)], "query_id string, t long")
    got = dict(rows(pit.asof_count(q, spark.createDataFrame([(x,) for x in obs], "o long"), "query_id", "t", "o")))
    assert got == {f"q{i}": bisect.bisect_right(obs, t) for i, t in enumerate(at)}


def test_witness(spark):
    r = spark.createDataFrame([("c", 1, "e1", "A"), ("c", 2, "e2", "A"), ("c", 3, "e3", "B"), ("c", 3, "e0", "B"), ("d", 9, "e4", "B"), ("c", 4, "e5", "")], "chain string, t long, id string, v string")
    c = r.where("v <> ''").withColumn("at", F.lit(5).cast("long"))
    got = {x["id"]: x["witness"] for x in pit.first_witness(c, r, ["chain"], "t", "id", "v", "at", ["id"]).collect()}
    assert got == {"e1": "e0", "e2": "e0", "e3": None, "e0": None, "e4": None}
    blind = c.withColumn("at", F.lit(2).cast("long"))
    assert pit.first_witness(blind, r, ["chain"], "t", "id", "v", "at", ["id"]).where("superseded").count() == 0
    assert {x["id"] for x in pit.superseded_semi(c, r.where("v <> ''"), ["chain"], "t", "v", "at").collect()} == {"e1", "e2"}


def test_chains_equal_a_plain_version(spark):
    """Witnesses and features of random chains with ties of time, repeated values and empty ones, against every row of the chain."""
    rng = random.Random(8)
    made = [(rng.choice("ab"), rng.randrange(12), f"e{i:03d}", rng.choice(["A", "A", "B", "C", ""])) for i in range(120)]
    asked = [(*row, row[1] + rng.choice([0, 1, 3, 9]), k) for k, row in enumerate(rng.choices(made, k=200))]
    r = spark.createDataFrame(made, "chain string, t long, id string, v string")
    c = spark.createDataFrame(asked, "chain string, t long, id string, v string, at long, k int")
    got = {x["k"]: x["witness"] for x in pit.first_witness(c, r, ["chain"], "t", "id", "v", "at", ["k"]).collect()}
    for chain, t, _, v, at, k in asked:
        later = [(u, j) for g, u, j, w in made if g == chain and t < u <= at and w not in ("", v)]
        assert got[k] == (min(later)[1] if later else None)
    semi = {x["k"] for x in pit.superseded_semi(c, r, ["chain"], "t", "v", "at").collect()}
    assert semi == {k for k, w in got.items() if w}
    feats = {x["k"]: x for x in learn.chain_features(c, r, ["chain"], "t", "id", "v", "at", ["k"]).collect()}
    assert len(feats) == len(asked)
    for chain, t, i, v, at, k in asked:
        seen = [(u, j, w) for g, u, j, w in made if g == chain and u <= at]
        newest = max(seen)
        newer = sum(u > t for u, _, _ in seen)
        assert (feats[k]["newer_count"], feats[k]["position"], feats[k]["newest_id"]) == (newer, 1 + sum((u, j) < (t, i) for u, j, _ in seen), newest[1])
        assert feats[k]["differs_from_newest"] == (newest[2] != v) and feats[k]["days_to_newest"] == pytest.approx((newest[0] - t) / 86_400e6 if newer else 0)


def test_splits_are_disjoint_in_time(spark):
    ev = spark.createDataFrame([("a", 2024), ("a", 2026), ("b", 2025), ("c", 2026), ("d", 2024)], "cve_id string, year int")
    seen = splits.periods(ev, "cve_id", "year")
    dev = spark.createDataFrame([("b",), ("c",)], "cve_id string")
    got = dict(rows(splits.assign(spark.createDataFrame([(x,) for x in "abcde"], "cve_id string"), seen, "cve_id", dev)))
    assert got == {"a": "train", "b": "dev", "c": "test", "d": "train", "e": "corpus_only"}
    assigned = spark.createDataFrame(list(got.items()), "cve_id string, split string")
    assert rows(splits.event_splits(ev, assigned, "cve_id", "year").select("cve_id", "year", "split")) == [("a", 2024, "train"), ("a", 2026, "future_event"), ("b", 2025, "dev"), ("c", 2026, "test"), ("d", 2024, "train")]
    with pytest.raises(Exception, match="split not open"):
        splits.guard(assigned).collect()
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(40)], "cve_id string")
    want = random.Random(Splits.seed).sample(sorted(f"k{i:03d}" for i in range(40)), 6)
    assert {r[0] for r in splits.seeded_sample(keys, "cve_id", 0.15, Splits.seed).collect()} == set(want)


DOC = {"cve_id": "C", "source_key": "s", "cvss_version": "3.1", "base_vector": "AV:N", "observed_from": 1, "source_file": "f", "chain_ambiguous": False, "evidence_text": "fine", "replaced_by_evidence_id": "x|2"}


@pytest.mark.parametrize(
    "change,want",
    [({}, None), ({"cve_id": ""}, "MISSING_CVE_ID"), ({"source_key": None}, "MISSING_SOURCE_KEY"), ({"cvss_version": "[UNKNOWN]"}, "MISSING_CVSS_VERSION"), ({"base_vector": "AV:*"}, "BASE_VECTOR_NOT_PARSEABLE"), ({"observed_from": None}, "MISSING_OBSERVED_FROM"), ({"source_file": ""}, "MISSING_PROVENANCE"), ({"chain_ambiguous": True}, "AMBIGUOUS_CHAIN"), ({"evidence_text": ""}, "TEXT_NOT_GENERATED"), ({"evidence_text": "the Former one"}, "TEXT_CONTAINS_LABEL_WORD"), ({"evidence_text": "see x|2"}, "TEXT_CONTAINS_FUTURE_INFO")],
)
def test_eligibility(spark, change, want):
    d = DOC | change
    df = spark.createDataFrame([tuple(d.values())], "cve_id string, source_key string, cvss_version string, base_vector string, observed_from long, source_file string, chain_ambiguous boolean, evidence_text string, replaced_by_evidence_id string")
    assert df.select(corpus.eligibility()).first()[0] == want
    with pytest.raises(ValueError, match="future"):
        corpus.assert_blind(df)


def test_bm25_equals_the_formula(spark):
    rng = random.Random(4)
    docs = [(f"d{i}", [rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))], i) for i in range(30)]
    qs = [("q1", ["a", "b", "a"], 20), ("q2", ["z"], 9), ("q3", ["c"], -1)]
    d = spark.createDataFrame(docs, "evidence_id string, t array<string>, observed_from long")
    q = spark.createDataFrame(qs, "query_id string, t array<string>, query_time long")
    got = retrieval.bm25(d, q, F.col("t"), F.col("t"), k=8)
    n, mean = len(docs), sum(len(x[1]) for x in docs) / len(docs)
    df = {w: sum(w in x[1] for x in docs) for w in "abcdefghij"}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items() if c}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if v < 0 else v for w, v in raw.items()}
    for qid, terms, at in qs:
        scored = []
        for e, t, obs in docs:
            if obs <= at:
                s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in terms)
                scored.append((-round(s, 9), __import__("hashlib").sha256(f"20260918|{qid}|{e}".encode()).hexdigest(), e))
        want = [e for _, _, e in sorted(scored)[:8]]
        assert [r["evidence_id"] for r in got.where(F.col("query_id") == qid).orderBy("rank").collect()] == want


def test_dense_equals_numpy_and_admits_ties(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(200, 8)).astype(np.float32)
    m[50:60] = m[7]
    v = spark.createDataFrame([(f"e{i}", [float(x) for x in r], i) for i, r in enumerate(m)], "evidence_id string, embedding array<float>, observed_from long").repartition(5)
    q = spark.createDataFrame([("q1", [float(x) for x in m[7]], 55), ("q2", [float(x) for x in m[3]], 500)], "query_id string, embedding array<float>, query_time long")
    got = retrieval.dense(v, q, 5, "observed_from", "query_time", question_bytes=1, vector_bytes=1000)
    for qid, i, at in (("q1", 7, 55), ("q2", 3, 500)):
        s = m.astype(float) @ m[i].astype(float)
        order = sorted((-round(s[j], 9), __import__("hashlib").sha256(f"20260918|{qid}|e{j}".encode()).hexdigest(), f"e{j}") for j in range(200) if j <= at)
        assert [r["evidence_id"] for r in got.where(F.col("query_id") == qid).orderBy("rank").collect()] == [e for _, _, e in order[:5]]


def test_seeded_draws_are_those_of_one_generator_over_sorted_keys(spark):
    names = [f"k{i * 7919 % 1000:03d}" for i in range(700)]
    frame = spark.createDataFrame([(n,) for n in names * 2], "k string").repartition(5)
    options = ("x", "y", "z", "w", "v")
    rng = random.Random(11)
    assert dict(rows(splits.seeded_choice(frame, "k", options, 11, "c"))) == {n: rng.choice(sorted(options)) for n in sorted(set(names))}
    assert sorted(r[0] for r in splits.seeded_sample(frame, "k", 0.15, 3).collect()) == sorted(random.Random(3).sample(sorted(set(names)), round(0.15 * 700)))
    places, total = splits.numbered(frame, "k")
    assert total == 700 and dict(rows(places)) == {n: i for i, n in enumerate(sorted(names))}
    assert splits.seeded_choice(frame.limit(0), "k", options, 1, "c").collect() == [] and splits.seeded_sample(frame.limit(0), "k", 0.5, 1).collect() == []
    with pytest.raises(ValueError, match="hash_sample"):
        splits.seeded_sample(frame, "k", 0.5, 1, most=10)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_questions_are_filled_up_without_a_join_by_inequality(spark, monkeypatch):
    """All questions are short; documents are observed at a few instants, so that spans and parts matter."""
    monkeypatch.setattr(retrieval, "TIED_DOCUMENTS", 7)
    monkeypatch.setattr(retrieval, "TIED_QUESTIONS", 3)
    docs = [(f"d{i}", ["a"] if i % 11 == 0 else ["b"], (i % 4) * 10 if i < 60 else 35) for i in range(90)]
    qs = [(f"q{j}", ["a"], t) for j, t in enumerate((-1, 0, 9, 10, 25, 30, 35, 99))]
    d = spark.createDataFrame(docs, "evidence_id string, t array<string>, observed_from long")
    q = spark.createDataFrame(qs, "query_id string, t array<string>, query_time long")
    found = retrieval.bm25(d, q, F.col("t"), F.col("t"), k=12)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["evidence_id"])
    key = lambda q, e: __import__("hashlib").sha256(f"20260918|{q}|{e}".encode()).hexdigest()
    for qid, _, at in qs:
        seen = [(t != ["a"], key(qid, e), e) for e, t, obs in docs if obs <= at]
        assert got.get(qid, []) == [e for _, _, e in sorted(seen)[:12]]
    assert not any(x in plan_of(found) for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))


def test_dense_takes_any_number_of_questions_as_data(spark):
    v = spark.createDataFrame([(f"e{i}", [float(i), 1.0]) for i in range(40)] + [("none", None)], "evidence_id string, embedding array<float>")
    for n, size in ((0, 100), (30, 24)):
        q = spark.createDataFrame([(f"q{j}", [1.0 if j % 2 else -1.0, 0.0]) for j in range(n)], "query_id string, embedding array<float>")
        got = retrieval.dense(v, q, 3, question_bytes=size, vector_bytes=64)
        assert got.count() == 3 * n
        for r in got.where("rank = 1").collect():
            assert r["evidence_id"] == ("e39" if int(r["query_id"][1:]) % 2 else "e0")
        assert "FlatMapCoGroupsInArrow" in plan_of(got) and "NestedLoop" not in plan_of(got)


def test_a_hot_entity_is_joined_in_parts(spark):
    """One entity has half of all rows: its rows are dealt over partitions, and the result is that of the plain join."""
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i % 50}", i, f"e{i}", [i]) for i in range(4000)] + [(None, 1, "n", None)], "entity string, o long, evidence_id string, more array<int>")
    q = spark.createDataFrame([(f"q{j}", "hot" if j < 6 else f"k{j % 50}", j * 70) for j in range(50)] + [("qn", None, 9)], "query_id string, entity string, t long")
    plain = q.join(rows, "entity").where("o <= t")
    whole, parts = (pit.asof_join(q, rows, ["entity"], "t", "o", hot=hot) for hot in (10_000, 100))
    assert whole.columns == parts.columns == plain.columns
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, whole.collect())) == want and sorted(map(str, parts.collect())) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count = lambda df: len(df.where("entity = 'hot'").select(F.spark_partition_id().alias("p")).distinct().collect())
        assert [count(pit.asof_join(q, rows, ["entity"], "t", "o", hot=hot)) for hot in (10_000, 100)] == [1, 4]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def pool(spark):
    made = [("q", "e1", 1, 3.0, "TARGET_OUTDATED", 40.0, True), ("q", "e2", 2, 2.0, "TARGET_CURRENT", 1.0, True), ("q", "e3", 3, 1.0, "OTHER_SOURCE_CURRENT", 9.0, False), ("q", "e4", 4, 1.0, "OTHER", 90.0, False)]
    return spark.createDataFrame(made, "query_id string, evidence_id string, rank int, score double, class string, age double, on_target boolean").withColumn("method", F.lit("base"))


def order(df):
    return [r["evidence_id"] for r in df.orderBy("rank").collect()]


def test_rerankers(spark):
    p = pool(spark)
    assert order(ranking.recency(p, F.col("age"))) == ["e2", "e3", "e1", "e4"]
    assert order(ranking.blended_recency(p, F.col("age"), F.lit(30.0), F.lit(5.0)))[0] == "e2"
    assert order(ranking.block_order(p, F.col("class") == "TARGET_OUTDATED", "rule")) == ["e2", "e3", "e4", "e1"]
    assert order(ranking.by_class(p, ranking.CURRENT_FIRST, "o")) == ["e2", "e3", "e1", "e4"] and order(ranking.by_class(p, ranking.TEMPORAL, "o")) == ["e2", "e3", "e4", "e1"]
    assert order(ranking.newest_tiebreak(p.withColumn("score", F.lit(1.0)), F.col("on_target"), F.col("age")))[:2] == ["e2", "e1"]
    assert ranking.same_candidates(p, ranking.recency(p, F.col("age"))).count() == 0 and ranking.same_candidates(p, p.where("rank < 4")).count() == 1
    assert ranking.overlap(p, p.where("rank < 4")).first()["ratio"] == 0.75 and ranking.prefix_mismatches(p.where("rank < 3"), p).count() == 0
    assert ranking.prefix_mismatches(p.withColumn("score", F.col("score") + 1), p).count() == 4


def test_fusion(spark):
    lists = [("q", "a", 1, "x"), ("q", "b", 2, "x"), ("q", "c", 3, "x"), ("q", "b", 1, "y"), ("q", "d", 2, "y")]
    got = ranking.rrf(spark.createDataFrame(lists, "query_id string, evidence_id string, rank int, method string"))
    assert order(got) == ["b", "a", "d", "c"] and got.where("evidence_id = 'b'").first()["input_ranks"] == {"x": 2, "y": 1}


def test_order_does_not_depend_on_hidden_columns(spark):
    p = pool(spark)
    scrambled = p.withColumn("label", F.rand(3)).withColumn("valid_until", F.rand(4)).repartition(3)
    assert order(ranking.recency(p, F.col("age"))) == order(ranking.recency(scrambled, F.col("age")))


def test_metrics(spark):
    p = pool(spark)
    better = ranking.block_order(p, F.col("class") == "TARGET_OUTDATED", "rule").select("query_id", "method", "evidence_id", "rank", "score", "class")
    m = {r["method"]: r.asDict() for r in evaluate.per_query(p.select(*better.columns).unionByName(better)).collect()}
    assert m["base"]["mrr@10"] == 0.5 and m["rule"]["mrr@10"] == 1.0 and m["base"]["stale@10"] == 0.1 and m["base"]["first_outdated_rank"] == 1
    assert m["rule"]["current_at1_no_stale@10"] == 0.0 and m["rule"]["top1_current"] == 1.0 and m["base"]["gap"] == -1.0
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    assert m["base"]["gndcg@10"] == pytest.approx(dcg / (2 + 1 / math.log2(3))) and m["rule"]["ndcg@10"] == 1.0
    top3 = evaluate.suppression(better, p.withColumn("method", F.lit("b")), k=3).first()
    assert (top3["outdated_suppression"], top3["current_preservation"]) == (1.0, 1.0)
    none = evaluate.suppression(better, p.where("class = 'OTHER'")).first()
    assert none["outdated_suppression"] is None and none["current_preservation"] is None
    gold = spark.createDataFrame([("q", 4, 0)], "query_id string, n_current int, n_other int")
    assert evaluate.per_query(better, gold).first()["recall@10"] == 0.25


def test_quantiles_below(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 2)], "x double")
    places = {"a": evaluate.lower_quantile(0.5), "b": evaluate.lower_quantile(1.0), "c": evaluate.upper_median}
    assert tuple(evaluate.at_place(df, [], "x", **places).first()) == (3.0, 5.0, 3.0)
    rng = random.Random(2)
    made = [(g, rng.choice([None, *range(6)])) for g in "abc" for _ in range(rng.randint(1, 40))]
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in evaluate.at_place(spark.createDataFrame(made, "g string, x int"), ["g"], "x", **places).collect()}
    for g in "abc":
        v = sorted(x for h, x in made if h == g and x is not None)
        assert got[g] == (v[min(len(v) - 1, len(v) // 2)], v[-1], v[len(v) // 2])


def test_poisson_bootstrap_is_that_of_plain_weights(spark):
    rng = random.Random(5)
    raw = [(f"c{i}", m, k, rng.random() if rng.random() < 0.9 else None) for i in range(400) for m in ("a", "b") for k in ("x", "y")]
    s = stats.cluster_sums(spark.createDataFrame(raw, "cve_id string, method string, metric string, value double"), "cve_id", ["method", "metric"]).repartition(3)
    got = stats.bootstrap_by_hash(s, "cve_id", ["method", "metric"], 2500, most=10)
    assert "Broadcast" not in plan_of(got) and got.columns == ["method", "metric", "replicate", "mean"]
    table = got.toPandas()
    keys = {r["cve_id"]: r["k"] for r in s.select("cve_id", F.xxhash64("cve_id").alias("k")).distinct().collect()}
    sums = s.toPandas()
    for (m, k), g in sums.groupby(["method", "metric"]):
        w = np.stack([stats.poisson_times(keys[c], stats.Statistics.seed, 2500) for c in g["cve_id"]])
        mean = (g["total"].fillna(0).to_numpy() @ w) / (g["n"].to_numpy() @ w)
        mine = table[(table["method"] == m) & (table["metric"] == k)].sort_values("replicate")["mean"].to_numpy()
        assert mine == pytest.approx(mean)
        drawn = stats.bootstrap_by_hash(s.where((F.col("method") == m) & (F.col("metric") == k)), "cve_id", ["method", "metric"], 2500).toPandas()["mean"]
        assert mine.mean() == pytest.approx(drawn.mean(), abs=2e-3) and mine.std() == pytest.approx(drawn.std(), rel=0.1)


def test_bootstrap(spark):
    v = spark.createDataFrame([("q1", "c1", "m", "x", 1.0), ("q2", "c1", "m", "x", 0.0), ("q3", "c2", "m", "x", 1.0), ("q4", "c2", "m", "x", None)], "query_id string, cve_id string, method string, metric string, value double")
    s = stats.cluster_sums(v, "cve_id", ["method", "metric"])
    assert rows(s.select("cve_id", "total", "n")) == [("c1", 1.0, 2), ("c2", 1.0, 1)]
    cfg = Statistics(replicates=300)
    a, b = (dict(rows(stats.bootstrap_by_generator(s, "cve_id", ["method", "metric"], cfg, block).select("replicate", "mean"))) for block in (300, 70))
    assert a == b and len(a) == 300 and set(np.round(list(a.values()), 6)) <= {0.5, round(2 / 3, 6), 1.0}
    draws = np.random.Generator(np.random.PCG64(cfg.seed)).integers(0, 2, (300, 2))
    assert a[0] == pytest.approx(np.array([1.0, 1.0])[draws[0]].sum() / np.array([2, 1])[draws[0]].sum())
    by_hash = stats.bootstrap_by_hash(s, "cve_id", ["method", "metric"], 50)
    assert by_hash.count() == 50
    low = stats.intervals(by_hash, ["metric"]).first()
    assert 0.5 <= low["low"] <= low["high"] <= 1.0
    both = by_hash.unionByName(by_hash.withColumn("method", F.lit("n")).withColumn("mean", F.col("mean") - 0.1))
    assert stats.paired_difference(both, "m", "n", ["metric"]).first()["p"] == pytest.approx(1 / 50)


def test_holm_and_wins(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.02)], "test string, p double")
    assert [(r["test"], round(r["p_holm"], 6)) for r in stats.holm(t).orderBy("test").collect()] == [("a", 0.003), ("b", 0.04), ("c", 0.04)]
    v = spark.createDataFrame([("q1", "n", "x", 1.0), ("q1", "b", "x", 0.5), ("q2", "n", "x", 0.2), ("q2", "b", "x", 0.2), ("q3", "n", "x", None), ("q3", "b", "x", 0.1), ("q1", "n", "stale", 0.3), ("q1", "b", "stale", 0.1)], "query_id string, method string, metric string, value double")
    assert rows(stats.win_loss_tie(v, "n", "b", ("stale",))) == [("stale", 0, 1, 0), ("x", 1, 0, 1)]
    assert stats.reconcile(v.where("method = 'n' AND metric = 'x'"), v.where("method = 'b' AND metric = 'x'"), ["query_id"]).count() == 2


def test_learning(spark):
    rng = random.Random(5)
    made = [(i, rng.gauss(0, 1), None if i % 9 == 0 else rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(made, "i int, a double, b double").withColumn("label", ((F.col("a") + F.coalesce("b", F.lit(0.0))) > 0).cast("int"))
    ready = learn.fit_preparation(df, ["a", "b"])
    have = sorted(x[2] for x in made if x[2] is not None)
    assert ready["b"][0] == pytest.approx(np.median(have))
    model = learn.fit(learn.prepare(df, ready), ["a", "b"], c=10.0)
    scored = learn.predict(learn.prepare(df, ready), model, ["a", "b"])
    c = learn.classification(scored).first()
    assert c["accuracy"] > 0.97 and c["tp"] + c["fp"] + c["fn"] + c["tn"] == 400
    y, p = zip(*[(r["label"], r["p"]) for r in scored.select("label", "p").collect()])
    pairs = [(a > b) + 0.5 * (a == b) for a, s in zip(p, y) if s for b, u in zip(p, y) if not u]
    assert learn.auc(scored).first()["auc"] == pytest.approx(np.mean(pairs))
    assert sum(r["n"] for r in learn.probability_deciles(scored).collect()) == 400
    assert learn.auc(scored.where("label = 1")).first()["auc"] is None
    whole = [(float(rng.randrange(300)) if i % 3 else rng.random(), int(rng.random() < 0.4)) for i in range(3000)]
    y, p = [w[1] for w in whole], [w[0] for w in whole]
    rank = {v: np.mean([i + 1 for i, x in enumerate(sorted(p)) if x == v]) for v in set(p)}
    want = (sum(rank[v] for v, s in whole if s) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (len(y) - sum(y)))
    for ranges in (2, 7, 256):
        assert learn.auc(spark.createDataFrame(whole, "p double, label int"), ranges=ranges).first()["auc"] == pytest.approx(want)


def test_strength_is_selected_on_dev(spark):
    rng = random.Random(6)
    made = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(600)]
    df = spark.createDataFrame([(a, b, int(a + 2 * rng.gauss(0, 1) > 0), i % 2) for i, (a, b) in enumerate(made)], "a double, b double, label int, half int")
    train, dev = df.where("half = 0"), df.where("half = 1")
    c, model, tried = learn.select_c(train, dev, ["a", "b"], (1e-4, 0.1, 10.0))
    assert dict(tried)[c] == min(dict(tried).values()) and c != 1e-4
    assert learn.select_c(train, dev, ["a"], (1.0, 1.0))[0] == 1.0


def test_feature_table(spark):
    df = spark.createDataFrame([("e", "e", "s", "t", True, None, 2, "x")], "entity string, q_entity string, source string, q_source string, superseded boolean, valid_from_censored boolean, newer_count int, template string")
    made, names, numeric = learn.feature_table(df, ["z", "s"], ["x", "y"])
    assert names == ["f_newer_in_chain", "f_superseded", "f_from_censored", "f_entity_matches", "f_source_matches", "f_template_x", "f_template_y", "f_source_s", "f_source_z"] and numeric == ["f_newer_in_chain"]
    assert [made.first()[n] for n in names] == [2.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert "f_superseded" not in learn.feature_table(df, [], with_rule=False)[1]


def test_gates(spark):
    good = pool(spark).withColumns({"query_time": F.lit(9), "observed_from": F.lit(3)})
    gates.require(gates.list_gates(good))
    with pytest.raises(RuntimeError, match="visibility"):
        gates.require(gates.list_gates(good.withColumn("observed_from", F.lit(10))))
    with pytest.raises(RuntimeError, match="rank_gaps"):
        gates.require(gates.list_gates(good.where("rank <> 2")))


EVIDENCE = {"evidence_id": "e", "cve_id": "C", "source_key": "s", "cvss_version": "3.1", "base_vector": "AV:N", "base_score": 7.0, "bt_score": None, "valid_from": 2, "valid_until": 9, "observed_from": 2, "valid_from_censored": False, "activation_event_id": "a", "replaced_by_evidence_id": "zz", "evidence_text": "As of then."}
ASKED = {"query_id": "q", "split": "test", "cve_id": "C", "source_key": "s", "cvss_version": "3.1", "query_role": "POST_REPLACEMENT_MAIN", "answer_evidence_id": "e", "replacing_new_evidence_id": "e", "answer_base_vector": "AV:N", "answer_base_score": 7.0, "multiple_current_targets": False, "current_evidence_ids": ["e"], "outdated_evidence_ids": ["o"], "visible_evidence_ids": ["e"], "query_time": 5}
EVIDENCE_TYPES = "evidence_id string, cve_id string, source_key string, cvss_version string, base_vector string, base_score double, bt_score double, valid_from long, valid_until long, observed_from long, valid_from_censored boolean, activation_event_id string, replaced_by_evidence_id string, evidence_text string"
ASKED_TYPES = "query_id string, split string, cve_id string, source_key string, cvss_version string, query_role string, answer_evidence_id string, replacing_new_evidence_id string, answer_base_vector string, answer_base_score double, multiple_current_targets boolean, current_evidence_ids array<string>, outdated_evidence_ids array<string>, visible_evidence_ids array<string>, query_time long"


def test_corpus_gates_fire_one_by_one(spark):
    other = ASKED | {"query_id": "q2", "split": "dev", "cve_id": "D"}
    cases = [
        ([], [], set()),
        ([{"evidence_text": "the Former one"}], [], {"text_without_label_words"}),
        ([{"evidence_text": "see zz"}], [], {"text_without_successor"}),
        ([{"valid_from_censored": True}], [], {"censored_sentence"}),
        ([{"activation_event_id": None}], [], {"start_is_an_activation"}),
        ([{}], [{}, {"query_id": "q"}], {"query_ids_unique"}),
        ([{}], [{}, {"split": "train"}], {"query_ids_unique", "one_split", "test_entities_apart"}),
        ([{}], [{}, {"split": "future_event"}], {"query_ids_unique", "one_split", "future_events_not_in_test"}),
        ([{}], [{}, other | {"cve_id": "C"}], {"test_entities_apart"}),
        ([{}], [{"source_key": "x"}], {"target_in_its_chain"}),
        ([{}], [{"current_evidence_ids": []}], {"main_has_current"}),
        ([{}], [{"outdated_evidence_ids": None}], {"main_has_outdated"}),
        ([{"valid_until": None}], [{"query_time": 50}], {"times_in_window"}),
        ([{}], [{"answer_base_vector": None}], {"answer_is_the_documents"}),
        ([{"bt_score": 5.0}], [{"answer_base_score": 5.0}], {"answer_is_the_documents", "answer_is_not_the_threat_score"}),
        ([{}], [{"multiple_current_targets": True}], {"one_current_target"}),
        ([{}], [{"query_time": 9}], {"before_the_next_replacement"}),
        ([{"observed_from": 6}], [], {"nothing_from_the_future"}),
        ([{}], [{"visible_evidence_ids": ["e", "unknown"]}], {"nothing_from_the_future"}),
    ]
    for docs, asked, want in cases:
        e = spark.createDataFrame([tuple((EVIDENCE | d).values()) for d in docs or [{}]], EVIDENCE_TYPES)
        q = spark.createDataFrame([tuple((ASKED | a).values()) for a in asked or [{}]], ASKED_TYPES)
        assert {r["gate"] for r in gates.corpus_gates(e, q, (0, 20)).where("NOT passed").collect()} == want
    twice = gates.corpus_gates(e.unionByName(e.withColumn("observed_from", F.lit(1).cast("long"))), q.limit(0), (0, 20), {"test": 1})
    assert {r["gate"] for r in twice.where("NOT passed").collect()} == {"evidence_ids_unique", "counts_as_listed"} and twice.count() == 19
    assert gates.corpus_gates(e.limit(0), q.limit(0), (0, 20), {}).where("NOT passed").count() == 0


def test_rule_counts_of_nothing_and_examples_with_ties(spark):
    p = pool(spark).withColumns({"suppressed": F.col("class") == "TARGET_OUTDATED", "witness": F.when(F.col("rank") == 1, "e2"), "other_rank": F.col("rank"), "chain": F.lit("c"), "v": F.lit("A"), "t": F.col("rank").cast("long"), "query_time": F.lit(1).cast("long")})
    got = {r["counter"]: r["value"] for r in diagnostics.rule_counts(p, p, ["chain"], "v", "t").collect()}
    assert (got["candidates"], got["suppressed"], got["suppressed_TARGET_OUTDATED"], got["witness_of_same_value"], got["witness_from_the_future"], got["witness_of_other_chain"]) == (4, 1, 1, 1, 1, 0)
    assert (got["queries_without_capacity"], got["forced_stale_at_k"], got["queries_with_same_list"], got["stale_rate_with_capacity"]) == (1, 1, 1, None)
    none = {r["counter"]: r["value"] for r in diagnostics.rule_counts(p.limit(0), p.limit(0), ["chain"], "v", "t").collect()}
    assert set(none) == set(got) and set(none.values()) == {0.0, None}
    more = p.unionByName(p.withColumn("query_id", F.lit("p")))
    assert rows(diagnostics.examples(more, {"any": F.lit(True), "gone": F.col("suppressed")}, 1).select("kind", "n", "query_id", "evidence_id")) == [("any", 1, "p", "e1"), ("gone", 1, "p", "e1")]


def test_configuration(tmp_path):
    from palimpsest import config

    (tmp_path / "t.yaml").write_text("observation_window: {start: '2024-01-01T02:00:00+02:00', end: 2024-05-01T00:00:00Z}\ntimeline: {supported_detail_types: [A], main_replacement_types: [M]}\n")
    (tmp_path / "a.json").write_text('{"aliases": [{"raw_identifier": "x@y", "normalized_source_key": "X"}]}')
    got = config.load_timeline(tmp_path / "t.yaml", tmp_path / "a.json")
    assert (got.window_start, got.window_end, got.detail_types, got.main_types, got.aliases) == ("2024-01-01T00:00:00+00:00", "2024-05-01T00:00:00+00:00", ("A",), ("M",), {"x@y": "X"})
    (tmp_path / "s.json").write_text('{"s": {"seed": 3, "train_years": [2020]}, "bad": {"sead": 3}}')
    assert config.load(Splits, tmp_path / "s.json", "s") == Splits(train_years=(2020,), seed=3)
    with pytest.raises(ValueError, match="sead"):
        config.load(Splits, tmp_path / "s.json", "bad")
    with pytest.raises(ValueError, match="time zone"):
        config.instant("2024-01-01T00:00:00")


def test_published_scores_are_classified(spark):
    v = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    docs = spark.createDataFrame([("C", "s", "3.1", v), ("D", "s", "3.1", v), ("C", "x", "3.1", v), ("C", None, "3.1", v)], "cve_id string, source_identifier_raw string, cvss_version string, vector string")
    told = spark.createDataFrame([("C", "s", "3.1", v, 9.8, "CRITICAL", v), ("D", "s", "3.1", v, 5.0, "MEDIUM", v)], "cve_id string, source string, version string, vector string, reported_score double, reported_severity string, vector_string string")
    got = {(r["cve_id"], r["source_identifier_raw"]): (r["reported_score"], r["reported_score_type"], r["reported_score_matches"]) for r in corpus.with_published(docs, told).collect()}
    none = (None, "NOT_AVAILABLE_IN_HISTORY", False)
    assert got == {("C", "s"): (9.8, "CVSS-B", True), ("D", "s"): (5.0, "UNRESOLVED", False), ("C", "x"): none, ("C", None): none}
    assert {r["reported_score_type"] for r in corpus.with_published(docs, told.limit(0)).collect()} == {none[1]}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "k string, v array<string>")
    files.write_csv(df, str(tmp_path / "c"), "|")
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert text.startswith("﻿k,v") and "a,x|y" in text
    files.write_jsonl(df, str(tmp_path / "j"), ["k"])
    assert sorted(p.name for p in (tmp_path / "j").glob("k=*")) == ["k=a", "k=b"]
    assert files.read_jsonl(spark, str(tmp_path / "j"), "k string, v array<string>").count() == 2
    cache = files.KeyedCache(spark, str(tmp_path / "cache"))
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert cache.missing(keys).count() == 2
    cache.append(spark.createDataFrame([("a", 1.0)], "key string, value double"))
    cache.append(spark.createDataFrame([("a", 1.0)], "key string, value double"))
    assert cache.read().count() == 1 and [r[0] for r in cache.missing(keys).collect()] == ["b"]
    with pytest.raises(ValueError, match="no row"):
        files.read_by_ids(df, spark.createDataFrame([("zz",)], "k string"), "k", ["v"])
    lines = spark.createDataFrame(list(enumerate(["text", "| name | mrr |", "|---|---|", "| bm25 | 0.7 |", "| rule | 0.9 |", "", "| other | x |"])), "line_no int, value string")
    assert rows(files.markdown_table(lines, "mrr")) == [("bm25", "0.7"), ("rule", "0.9")]
    inv = {r["extension"]: r["files"] for r in files.inventory(spark, str(tmp_path / "c")).collect()}
    assert inv[".csv"] >= 1
    assert files.describe(df) == [("k", "string"), ("v", "array<string>")] and "1,000" in files.text_table([("a", 1000)], ("k", "n")) and "&" in files.latex_table([("a", 1.0)], ("k", "n"))
    files.write_summary(str(tmp_path / "s.json"), files.manifest({"b": 1}, names={"y", "x"}))
    assert '"x",' in (tmp_path / "s.json").read_text()
