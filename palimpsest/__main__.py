"""Command line: ``python -m palimpsest timeline|corpus|audit|rank|significance|cohorts ...``."""

from __future__ import annotations

import argparse

import pandas as pd
from pyspark.sql import SparkSession

from palimpsest.config import Timeline
from palimpsest.functions import scores
from palimpsest.operators import gates
from palimpsest.plans import lifecycle
from palimpsest.session import collected


#: Metrics that are tested.
SIGNIFICANT = ("ndcg@10", "gndcg@10", "mrr@10", "recall@10", "stale@10", "current_at1_no_stale@10")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, needs in {"timeline": ("history-dir", "out"), "corpus": ("intervals", "out"), "audit": ("out",), "rank": ("corpus", "queries", "out"), "significance": ("metrics", "queries", "baseline", "out"), "cohorts": ("corpus", "queries", "out")}.items():
        sub = commands.add_parser(name)
        for need in needs:
            sub.add_argument(f"--{need}", required=True)
        if name == "corpus":
            sub.add_argument("--score-table", help="JSON file of the standard's table for version 4.0: {macro vector: score}")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if given.command == "timeline":
        lifecycle.build_timeline(spark, given.history_dir, given.out)
    elif given.command == "corpus":
        lookup = scores.read_score_table(given.score_table) if given.score_table else None
        lifecycle.build_corpus(spark, spark.read.parquet(given.intervals), given.out, lookup)
    elif given.command == "audit":
        lifecycle.audit_corpus(spark, given.out)
    elif given.command == "significance":
        lifecycle.prepare(spark)
        metrics, queries = spark.read.parquet(given.metrics), spark.read.parquet(given.queries)
        with collected(spark):
            intervals, tests = lifecycle.significance(metrics, queries, given.baseline, SIGNIFICANT)
            intervals.write.mode("overwrite").json(f"{given.out}/intervals")
            tests.write.mode("overwrite").json(f"{given.out}/tests")
    elif given.command == "cohorts":
        from palimpsest.plans import cohorts

        lifecycle.prepare(spark)
        end = int(pd.Timestamp(Timeline().window_end).value // 1000)
        with collected(spark):
            cohorts.run(spark, spark.read.parquet(given.corpus), spark.read.parquet(given.queries), given.out, end)
    else:
        lifecycle.prepare(spark)
        documents, queries = spark.read.parquet(given.corpus), spark.read.parquet(given.queries)
        with collected(spark):
            lists = lifecycle.rerank_by_rules(lifecycle.retrieve(queries, documents), documents)
            lists.write.mode("overwrite").partitionBy("method").parquet(f"{given.out}/lists")
            stored = spark.read.parquet(f"{given.out}/lists")
            gates.require(gates.list_gates(stored))
            metrics, report = lifecycle.evaluate_lists(stored, queries)
            metrics.write.mode("overwrite").parquet(f"{given.out}/metrics")
            report.write.mode("overwrite").json(f"{given.out}/report")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
