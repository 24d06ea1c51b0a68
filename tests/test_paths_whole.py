"""Feasible paths of any length."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadfold.operators import counterfactual as cf


def test_limit_is_reported(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "record_id int, x double")
    cells = cf.density_cells(df, {"x": 1.0}, F.col("x"), 1.0, 0.01)
    steps = {r["c_x"]: r["path_steps"] for r in cf.feasible_paths(cells, {"x": [-1]}, {"x": 1.0}).collect()}
    assert steps == {i: i for i in range(11)}
    for limit, reached in ((3, True), (9, True), (10, False), (40, False)):
        rows = cf.feasible_paths(cells, {"x": [-1]}, {"x": 1.0}, limit).collect()
        assert {r["limit_reached"] for r in rows} == {reached}
        assert {r["c_x"] for r in rows if r["path_cost"] is None} == set(range(limit + 1, 11))
