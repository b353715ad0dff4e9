"""Metamorphic checks, the lock of the learned run, cached scores, and cohorts of questions."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import checks, learn, ranking, retrieval
from palimpsest.plans import checked, cohorts
from palimpsest.session import collected, kept
from palimpsest.sources.files import KeyedCache

DAY = 86_400_000_000


def small_pool(spark):
    rows = [("q1", "e1", 1, 3.0, "TARGET_OUTDATED", 5, 1, 10, 2, "a"), ("q1", "e2", 2, 2.0, "TARGET_CURRENT", 7, 2, 10, None, "a"), ("q1", "e3", 3, 1.0, "OTHER", 1, 9, 10, None, "b"), ("q2", "e1", 1, 1.0, "TARGET_CURRENT", 5, 1, 6, 2, "a")]
    pool = spark.createDataFrame(rows, "query_id string, evidence_id string, rank int, score double, class string, valid_from long, value long, query_time long, replaced_by long, e_source string")
    return pool.withColumns({"entity": F.lit("x"), "source": F.lit("a"), "on_target": F.col("e_source") == "a", "age": (F.col("query_time") - F.col("valid_from")).cast("double"), "method": F.lit("base"), "label": F.lit("l"), "relation": F.lit("r"), "valid_until": F.col("replaced_by")})


def corpus(spark):
    return spark.createDataFrame([("x", "a", 1, "e1", 1, 5), ("x", "a", 2, "e2", 2, 7), ("x", "b", 3, "e3", 9, 1)], "entity string, source string, id long, evidence_id string, value long, valid_from long")


def test_a_reranker_that_looks_ahead_or_at_labels_fails(spark):
    pool, rows = small_pool(spark), corpus(spark)
    ahead = checks.with_future(rows, pool, ["entity", "source"], "valid_from", "evidence_id", "value", "query_time")
    added = ahead.join(rows.select("evidence_id"), "evidence_id", "left_anti").collect()
    assert len(added) == 2 and all(r["valid_from"] == 11 for r in added) and {r["value"] for r in added} == {3, 10}

    def looks_ahead(pool, rows):
        newest = rows.groupBy("entity", F.col("source").alias("e_source")).agg(F.max("valid_from").alias("last"))
        return ranking.block_order(pool.join(newest, ["entity", "e_source"]), F.col("valid_from") < F.col("last"), "ahead")

    cheats = {"ahead": looks_ahead, "labels": lambda pool, rows: ranking.by_class(pool, ranking.CURRENT_FIRST, "o"), "order": lambda pool, rows: ranking.rerank(pool.withColumn("score", F.spark_partition_id().cast("double")), [F.col("score"), F.monotonically_increasing_id()], "x")}
    methods = checked.rerankers() | {k: cheats[k] for k in ("ahead", "labels")}
    hidden = {m: ("class", "label", "relation", "valid_until") + (() if m == "rule_direct" else ("replaced_by",)) for m in methods}
    got = {(r["method"], r["property"]): (r["candidates"], r["changed"]) for r in checks.metamorphic(methods, pool, rows, ahead, hidden).collect()}
    assert len(got) == 3 * len(methods) and all(n == 4 for n, _ in got.values())
    assert {k for k, (_, bad) in got.items() if bad} <= {("ahead", "future"), ("labels", "forbidden")} and got["ahead", "future"][1] > 0 and got["labels", "forbidden"][1] > 0


def test_test_rows_stay_shut_until_the_manifest_is_locked(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}", f"e{i}", float(i % 7), float(i % 3) if i % 5 else None, int(i % 7 > 3), ("train", "dev", "test")[i % 3]) for i in range(300)], "query_id string, evidence_id string, f_a double, f_b double, label int, role string")
    path = str(tmp_path / "lock")
    with pytest.raises(FileNotFoundError):
        learn.open_test(spark, rows, path)
    train, dev = rows.where("role = 'train'"), rows.where("role = 'dev'")
    preparation = learn.fit_preparation(train, ["f_a", "f_b"])
    c, model, _ = learn.select_c(learn.prepare(train, preparation), learn.prepare(dev, preparation), ["f_a", "f_b"])
    manifest = learn.manifest_of(model, ["f_a", "f_b"], preparation, c, seed=1)
    seal = learn.lock(spark, manifest, path)
    assert learn.lock(spark, manifest, path) == seal
    with pytest.raises(ValueError, match="another"):
        learn.lock(spark, manifest | {"c": 99.0}, path)
    test, found = learn.open_test(spark, rows, path)
    assert found == json.loads(json.dumps(manifest)) and test.count() == 100
    by_model = {r["query_id"]: r["p"] for r in learn.predict(learn.prepare(test, preparation), model, ["f_a", "f_b"]).collect()}
    by_manifest = {r["query_id"]: r["p"] for r in learn.score_by(test, found).collect()}
    assert by_manifest == pytest.approx(by_model, abs=1e-12) and len(by_manifest) == 100
    file = next(pathlib.Path(path).glob("part-*.json"))
    file.write_text(file.read_text().replace('\\"alpha\\": null', '\\"alpha\\": 0.5'))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="changed"):
        learn.unlock(spark, path)


def test_agreement_counts_decisions_and_lists(spark):
    schema = "query_id string, evidence_id string, rank int, suppressed boolean, on boolean, role string"
    mine = spark.createDataFrame([("q1", "a", 1, False, True, "t"), ("q1", "b", 2, True, True, "t"), ("q2", "a", 1, True, True, "t"), ("q2", "c", 2, False, False, "t")], schema)
    rule = spark.createDataFrame([("q1", "a", 1, False, True, "t"), ("q1", "b", 2, True, True, "t"), ("q2", "a", 2, False, True, "t"), ("q2", "c", 1, True, False, "t")], schema)
    r = learn.agreement(mine, rule, F.col("on"), ["role"]).first()
    assert (r["queries"], r["candidates"], r["by_model"], r["by_rule"], r["by_both"], r["off_target"], r["same_decisions"], r["same_lists"]) == (2, 4, 2, 1, 1, 0, 1, 1)


def test_a_pair_is_scored_once(spark, tmp_path):
    cache, asked = KeyedCache(spark, str(tmp_path / "c")), []

    def score(todo):
        asked.append(sorted(r["key"] for r in todo.collect()))
        return todo.withColumn("score", F.length("key").cast("double"))

    pairs = spark.createDataFrame([("a", "x"), ("bb", "y"), ("a", "z")], "k string, more string")
    got = retrieval.cached_scores(pairs, cache, F.col("k"), score)
    assert sorted(map(tuple, got.collect())) == [("a", "x", 1.0), ("a", "z", 1.0), ("bb", "y", 2.0)] and asked[0] == ["a", "bb"]
    more = retrieval.cached_scores(spark.createDataFrame([("bb", "q"), ("ccc", "r")], "k string, more string"), cache, F.col("k"), score)
    assert sorted(map(tuple, more.collect())) == [("bb", "q", 2.0), ("ccc", "r", 3.0)] and asked[1] == ["ccc"] and cache.read().count() == 3


def test_questions_asked_later(spark):
    documents = spark.createDataFrame([("e1", 10 * DAY, None), ("e2", 10 * DAY, 20 * DAY)], "evidence_id string, valid_from long, valid_until long")
    queries = spark.createDataFrame([("q1", "e1", 11 * DAY), ("q2", "e2", 11 * DAY)], "query_id string, answer_evidence_id string, query_time long").withColumns({"query_template_id": F.lit("base_severity"), "cvss_version": F.lit("3.1"), "source_key": F.lit("s"), "cve_id": F.lit("C")})
    kept_, gone = cohorts.asked_later(queries, documents, 45 * DAY, (1, 30, 90))
    assert sorted((r["query_id"], r["query_time"] // DAY, r["original_id"], r["original_time"] // DAY) for r in kept_.collect()) == [("q1+1", 11, "q1", 11), ("q1+30", 40, "q1", 11), ("q2+1", 11, "q2", 11)]
    assert {r["query_text"][:16] for r in kept_.collect()} == {"As of 1970-01-12", "As of 1970-02-10"}
    assert sorted(map(tuple, gone.collect())) == [(30, "q2", "CURRENT_INTERVAL_ENDS_BEFORE_OFFSET"), (90, "q1", "BEYOND_OBSERVATION_WINDOW"), (90, "q2", "CURRENT_INTERVAL_ENDS_BEFORE_OFFSET")]


def test_tables_of_a_run_are_removed(spark):
    with collected(spark):
        frame = kept(spark.range(5).toDF("x"))
        path = frame.inputFiles()[0].removeprefix("file:")
        assert frame.count() == 5 and pathlib.Path(path).exists()
    assert not pathlib.Path(path).exists()
