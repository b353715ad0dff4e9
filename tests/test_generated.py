"""Generated questions collect their ids where they meet them."""

from pyspark.sql import functions as F

from palimpsest.operators import pit
from palimpsest.plans import catalogue


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString().splitlines()


def test_ids_of_generated_questions_are_collected_where_they_meet(spark, sf):
    lines = plan_of(catalogue.queries()["generated_queries"](spark, sf))
    first = next(i for i, line in enumerate(lines) if "collect_list(" in line and "eid" in line)
    assert not [line for line in lines[:first] if "Exchange" in line or "Join" in line]


def test_a_question_that_sees_nothing_keeps_a_row(spark):
    asked = spark.createDataFrame([("a", "q1", 5), ("a", "q2", 0), ("b", "q3", 5), (None, "q4", 5)], "k string, query_id string, t long")
    rows = spark.createDataFrame([("a", "e1", 1), ("a", "e2", 9), (None, "e3", 1)], "k string, evidence_id string, o long")
    pairs = rows.groupBy("k").agg(F.lit(10).cast("long").alias("__pairs"))
    for most in (3, 1000):
        found = pit.asof_cells(asked, rows, ["k"], "t", "o", pairs, most=most, how="left")
        assert sorted(map(tuple, found.select("query_id", "evidence_id").collect())) == [("q1", "e1"), ("q2", None), ("q3", None), ("q4", None)]
