"""Pages of changes are bounded, and read without writing them out again."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.plans import sourced
from palimpsest.sources import changelog


def test_pages_of_changes_grow_in_number(spark, sf, monkeypatch):
    monkeypatch.setattr(sourced, "PAGES", 2, raising=False)
    monkeypatch.setattr(sourced, "PAGE_CHANGES", 10, raising=False)
    pages = sourced.change_pages(spark, sf).withColumn("n", F.size(F.split("text", '"change":')) - 1)
    whole = pages.agg(F.count("*").alias("pages"), F.max("n").alias("most")).first()
    assert whole["pages"] > 50 + 3 and whole["most"] < 40


@pytest.mark.parametrize("raw", ["null", "{}", '{"a": [1]}', "[]", "[null]", "true", "1", "1.5", "1e300", '"x"', '"[]"', None])
def test_variant_shape_is_that_of_its_text(spark, raw):
    row = spark.createDataFrame([(raw,)], "x string").select(text.value_shape(F.col("x")).alias("want"), text.variant_shape(F.try_parse_json("x")).alias("got")).first()
    assert row["got"] == row["want"]


def test_issues_are_found_in_one_pass_over_the_changes(spark):
    pages = spark.createDataFrame([("f", "{}")], "source_file string, text string")
    assert sum("Generate posexplode" in line for line in changelog.issues(pages)._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
