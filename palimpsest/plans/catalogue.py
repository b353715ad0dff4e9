"""One query for each operator over the driver's tables, and the same in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as long and doubles rounded, so that engines can be compared."""
    from pyspark.sql import functions as F

    kinds = {"int": lambda c: F.col(c).cast("long"), "bigint": F.col, "double": lambda c: F.round(c, digits)}
    return frame.select(*[kinds.get(kind, F.col)(c).alias(c) for c, kind in frame.dtypes])


def query(sql: str | None = None, digits: int = 6):
    """Register a query; ``sql`` is its equivalent in DuckDB's dialect."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(prepare(spark), sf_dir), digits)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from palimpsest.plans import checked, cohorts, learned, points, ranked, relational, replayed, scalar, sourced, summaries  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLE
