"""Tables of a run appear together or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from steadfold.sources import publish, published, read_published


def rows(spark, n, year):
    return spark.range(n).select("id", F.lit(year).alias("year"), (F.col("id") % 2).cast("string").alias("area"))


def counts(spark, root, name):
    return {r["run_id"]: r["n"] for r in read_published(spark, root, name).groupBy("run_id").agg(F.count("*").alias("n")).collect()}


def test_nothing_is_published_before_the_commit(spark, tmp_path):
    root = f"{tmp_path}/out"
    good, broken = rows(spark, 10, 2024), rows(spark, 5, 2024).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, {"processed": good, "quarantine": broken}, root, "2024", {"processed": ["year", "area"]})
    assert published(spark, root).count() == 0
    with pytest.raises(LookupError):
        read_published(spark, root, "processed")
    publish(spark, {"processed": good, "quarantine": rows(spark, 3, 2024)}, root, "2024", {"processed": ["year", "area"]})
    assert (counts(spark, root, "processed"), counts(spark, root, "quarantine")) == ({"2024": 10}, {"2024": 3})
    with pytest.raises(Exception, match="lost"):  # a failed repeat leaves what was published
        publish(spark, {"processed": rows(spark, 99, 2024), "quarantine": broken}, root, "2024", {"processed": ["year", "area"]})
    assert (counts(spark, root, "processed"), counts(spark, root, "quarantine")) == ({"2024": 10}, {"2024": 3})


def test_runs_and_repeats(spark, tmp_path):
    root = f"{tmp_path}/out"
    publish(spark, {"a": rows(spark, 4, 2024), "b": rows(spark, 2, 2024)}, root, "2024/x", {"a": ["area"]})
    publish(spark, {"a": rows(spark, 6, 2025).drop("year")}, root, "2025")
    assert (counts(spark, root, "a"), counts(spark, root, "b")) == ({"2024/x": 4, "2025": 6}, {"2024/x": 2})
    got = read_published(spark, root, "a", ["2024/x"])
    assert dict(got.dtypes)["area"] == "string" and {r["year"] for r in got.collect()} == {2024}
    publish(spark, {"a": rows(spark, 0, 2024)}, root, "2024/x")
    assert counts(spark, root, "a") == {"2025": 6} and read_published(spark, root, "a", ["2024/x"]).columns == ["id", "year", "area", "run_id"]
    with pytest.raises(LookupError):
        read_published(spark, root, "b")
