"""Every query against its SQL on the smallest tables, the stream, and the engine end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.plans import catalogue, lifecycle
from tests.test_timeline import A, B, C, change, day

NAMES = sorted(catalogue.queries())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def normal(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    frame = catalogue.queries()[name](spark, sf)
    got = [tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()]
    if name in catalogue.oracle_sql():
        relation = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(relation.columns) == sorted(frame.columns)
        order = [relation.columns.index(c) for c in sorted(relation.columns)]
        want = [tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order) for r in relation.fetchall()]
        assert normal(got) == normal(want)
    else:
        assert got


def test_generator_intervals_rest_on_all_replicates(spark, sf):
    import numpy as np

    from palimpsest.config import Statistics
    from palimpsest.operators import stats
    from palimpsest.plans import ranked

    sums = stats.cluster_sums(ranked.values(spark, sf), "entity", ["method", "metric"]).toPandas()
    units = sorted(sums["entity"].unique())
    draws = np.random.Generator(np.random.PCG64(Statistics.seed)).integers(0, len(units), (10_000, len(units)))
    got = {(r["method"], r["metric"]): (r["low"], r["high"]) for r in ranked.bootstrap_generator(spark, sf).collect()}
    for key, g in sums.groupby(["method", "metric"]):
        by = g.set_index("entity").reindex(units).fillna(0)
        n = by["n"].to_numpy()[draws].sum(1)
        mean = by["total"].to_numpy()[draws].sum(1)[n > 0] / n[n > 0]
        assert got[key] == pytest.approx(tuple(np.percentile(mean, [2.5, 97.5])))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(entry.__file__ if os.path.isabs(entry.__file__) else os.path.abspath(entry.__file__)))) or "."
    package = os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "palimpsest")
    for folder, _, names in os.walk(package):
        if os.path.basename(folder) == "llm" or root is None:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, n)).read(), n


def test_stream_goes_on_where_it_stopped(spark, sf, tmp_path):
    from palimpsest.streaming.chains import replay_files

    first = replay_files(spark, sf, str(tmp_path / "o"), str(tmp_path / "c")).count()
    assert first > 0 and replay_files(spark, sf, str(tmp_path / "o"), str(tmp_path / "c")).count() == first


def test_end_to_end(spark, tmp_path):
    vec = [A, B, C, A.replace("AC:L", "AC:H")]
    changes = []
    for e in range(12):
        year = "2026" if e % 3 == 2 else "2024"
        for s in ("s1", "s2"):
            c = [change("2024-01-10T10:00:00.000", ("Added", vec[e % 2]), cve=f"CVE-{e}", source=s)]
            c.append(change(f"{year}-0{2 + e % 4}-15T10:00:00.000", ("Removed", vec[e % 2]), ("Added", vec[2 + e % 2]), cve=f"CVE-{e}", source=s))
            changes += c
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text(json.dumps({"cveChanges": changes}))
    (tmp_path / "h" / "bad.json").write_text("{")
    t = lifecycle.build_timeline(spark, str(tmp_path / "h"), str(tmp_path / "t"))
    assert t["intervals"].count() == 48 and t["issues"].count() == 1 and t["replacements"].where("tier = 'STRICT'").count() == 24
    c = lifecycle.build_corpus(spark, t["intervals"], str(tmp_path / "c"))
    assert c["corpus"].count() == 48 and c["excluded_intervals"].count() == 0
    assert {r["split"] for r in c["splits"].collect()} <= {"train", "dev", "test"} and c["splits"].count() == 12
    q = c["queries"]
    assert q.count() + c["excluded_queries"].count() == 48 and q.where("query_role = 'POST_REPLACEMENT_MAIN'").count() == 24
    row = q.where("query_role = 'POST_REPLACEMENT_MAIN'").first()
    assert row["answer_evidence_id"] == row["replacing_new_evidence_id"] and row["replaced_old_evidence_id"] in row["outdated_evidence_ids"] and set(row["current_evidence_ids"]) <= set(row["visible_evidence_ids"])
    counts = {r["split"]: r["n"] for r in q.groupBy("split").agg(F.count("*").alias("n")).collect()}
    audited = lifecycle.audit_corpus(spark, str(tmp_path / "c"), counts)
    assert audited.count() == 19 and audited.agg(F.sum("violations")).first()[0] == 0
    with pytest.raises(RuntimeError, match="counts_as_listed"):
        lifecycle.audit_corpus(spark, str(tmp_path / "c"), {"train": 0})
    main = q.where("query_role = 'POST_REPLACEMENT_MAIN'")
    found = lifecycle.retrieve(main, c["corpus"])
    lists = lifecycle.rerank_by_rules(found, c["corpus"]).persist()
    metrics, report = lifecycle.evaluate_lists(lists, main)
    by = {r["method"]: r for r in report.where("grouping = 'all'").collect()}
    assert by["rule_target"]["top1_current"] >= by["bm25"]["top1_current"] and by["oracle_temporal"]["stale@10"] <= by["bm25"]["stale@10"] and by["oracle_temporal"]["top1_current"] == 1.0
    assert by["bm25"]["queries"] == 24 and metrics.count() == 24 * 8
    from palimpsest.operators import gates, retrieval

    gates.require(gates.list_gates(lists))
    fused = lifecycle.hybrid(found, main, c["corpus"], retrieval.hashing_encoder(), "r1")
    assert fused.where("observed_from > query_time").count() == 0 and fused.select("query_id").distinct().count() == 24
    assert lifecycle.sample_queries(main, 2).groupBy("split").count().where("count > 2").count() == 0


    tested, family = lifecycle.significance(metrics, main, "bm25", ("ndcg@10", "stale@10"), __import__("palimpsest.config", fromlist=["Statistics"]).Statistics(replicates=200))
    tests = {r["test"]: r for r in family.collect()}
    assert tested.count() == 16 and len(tests) == 14 and all(r["p"] <= r["p_holm"] <= 1 and r["diff_low"] <= r["diff_high"] for r in tests.values())
    assert tests["oracle_temporal|stale@10"]["diff_high"] <= 0 and {r["method"]: r["mean"] for r in tested.where("metric = 'stale@10'").collect()}["bm25"] == pytest.approx(by["bm25"]["stale@10"])

    from palimpsest.plans import cohorts

    done = cohorts.run(spark, c["corpus"], q, str(tmp_path / "x"), 1_788_000_000_000_000, (1, 60))
    assert done["offset_lists"].where("observed_from > query_time").count() == 0 and done["offset_overlap"].where("overlap > 1").count() == 0
    assert done["offset_lists"].select("query_id").distinct().count() + done["offset_excluded"].count() == 2 * main.count()
    report = done["control_report"].agg(*[F.sum(x).alias(x) for x in ("queries", "visibility_violations", "replacing_in_pool")]).first()
    assert report["queries"] == q.where("query_role = 'PRE_REPLACEMENT_CONTROL'").count() and report["visibility_violations"] == report["replacing_in_pool"] == 0


def test_command_line(spark, tmp_path):
    from palimpsest.__main__ import main

    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text(json.dumps({"cveChanges": [change(day(1), ("Added", A))]}))
    assert main(["timeline", "--history-dir", str(tmp_path / "h"), "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o" / "intervals")).count() == 1
