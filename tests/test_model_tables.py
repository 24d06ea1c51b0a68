"""Models as tables: the same probabilities as the model object, and plain softmax sums."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from steadfold.operators import model_tables, training

FEATURES = ["a", "b"]


def drawn(classes):
    r = random.Random(len(classes))
    rows = []
    for i in range(900):
        a, b = r.gauss(0, 1), r.gauss(3, 5)
        rows.append((i, a, b, classes[min(range(len(classes)), key=lambda c: abs(a + b / 5 + r.gauss(0, 1) - c))]))
    return rows


@pytest.mark.parametrize("classes", [["0", "1"], ["x", "y", "z"]])
def test_scores_and_optimum(spark, classes):
    data = spark.createDataFrame(drawn(classes), "record_id int, a double, b double, label string")
    model = training.train(data, "logistic", FEATURES, classes=classes)
    table = model_tables.logistic_table(spark, model, "1.0", FEATURES, classes)
    own = training.score(data, model, "1.0", classes, keep=["record_id", "label", *FEATURES]).withColumnRenamed("probs", "model_probs")
    both = model_tables.score_by_table(own, table, FEATURES, n_versions=1)
    assert both.columns == [*own.columns, "probs"]
    for r in both.collect():
        assert all(math.isclose(r.probs[c], r.model_probs[c], abs_tol=1e-9) for c in classes)
    at = model_tables.gradient(both, FEATURES).collect()
    assert len(at) == 3 * len(classes) and all(r.n == 900 and abs(r.gradient) < 1e-3 for r in at)
    off = table.withColumn("weight", F.when(F.col("feature") == "b", 0.0).otherwise(F.col("weight")))
    moved = model_tables.gradient(model_tables.score_by_table(own, off, FEATURES), FEATURES)
    assert moved.agg(F.max(F.abs("gradient"))).first()[0] > 0.05


def test_rows_choose_their_version(spark):
    flat = [("1.0", "n", "(intercept)", 0.5), ("1.0", "p", "a", 2.0), ("2.0", "n", "a", 0.0), ("2.0", "p", "b", -1.0), ("2.0", "p", "(intercept)", 900.0)]
    table = spark.createDataFrame(flat, "model_version string, class string, feature string, weight double")
    rows = [(1, "1.0", 1.0, 9.0, 7), (2, "2.0", 1.0, 2.0, 7), (3, "3.0", 1.0, 2.0, 7), (4, "1.0", None, 2.0, 7), (5, None, 1.0, 1.0, 7), (1, "1.0", 1.0, 9.0, 7)]
    df = spark.createDataFrame(rows, "id int, model_version string, a double, b double, w int")
    got = [(r.id, r.probs, r.w) for r in model_tables.score_by_table(df, table, FEATURES).orderBy("id").collect()]
    p = 1 / (1 + math.exp(0.5 - 2.0))
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5] and {g[2] for g in got} == {7}
    assert all(math.isclose(g[1]["p"], p) and math.isclose(g[1]["n"], 1 - p) for g in got[:2])
    assert got[2][1] == {"n": 0.0, "p": 1.0} and [g[1] for g in got[3:]] == [None] * 3
    assert model_tables.score_by_table(df.limit(0), table, FEATURES).count() == 0
    assert model_tables.gradient(df.limit(0).withColumn("label", F.lit("p")).withColumn("probs", F.lit(None).cast("map<string,double>")), FEATURES).count() == 0
