"""The logistic regression: the same optimum as Spark's own, in a bounded number of passes for all strengths together."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from palimpsest.operators import learn


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1]
    y = (x @ [1.0, -0.4, 2.0] + rng.logistic(size=400) > 0.3).astype(int)
    return spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, label int").cache()


def test_models_are_those_of_spark(rows):
    strengths = (0.01, 1.0, 100.0)
    vector = rows.select(array_to_vector(F.array("a", "b", "c")).alias("features"), F.col("label").cast("double").alias("label"))
    for c, model in zip(strengths, learn.fit_all(rows, ["a", "b", "c"], "label", strengths)):
        want = LogisticRegression(regParam=1.0 / (c * 400), standardization=False, maxIter=1000, tol=1e-12).fit(vector)
        assert [model.intercept, *model.weights] == pytest.approx([want.intercept, *want.coefficients.toArray()], abs=1e-4)


def test_all_strengths_take_few_passes(rows, monkeypatch):
    passes = []
    frame = type(rows)
    plain = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **k: passes.append(1) or plain(self, *a, **k))
    learn.select_c(rows, rows, ["a", "b", "c"])
    assert 0 < len(passes) <= 15


def test_one_class_and_separable_rows(spark, rows):
    same = learn.fit(rows.withColumn("label", F.lit(1)), ["a", "b", "c"])
    assert learn.predict(rows, same, ["a", "b", "c"]).agg(F.min("p")).first()[0] == 1.0
    apart = learn.fit(rows.withColumn("label", (F.col("a") > 0).cast("int")), ["a", "b", "c"], c=100.0)
    assert np.isfinite([apart.intercept, *apart.weights]).all() and apart.weights[0] > 1
