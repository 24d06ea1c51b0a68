"""Logistic models as tables: one row per (version, class, feature), scored without the model object.

A table can be kept beside the scores, compared between versions in SQL, and evaluated by any engine.
Rows carry the version that scores them, so one pass serves several versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import join_bounded, literal_table

INTERCEPT = "(intercept)"


def logistic_table(spark: SparkSession, model, version: str, features: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """``(model_version, class, feature, weight)`` of a fitted logistic model (a pipeline's last stage).

    Two classes have one vector of weights, which belongs to the second; the first one's are zero.
    """
    fitted = model.stages[-1]
    weights, intercepts = fitted.coefficientMatrix.toArray(), list(fitted.interceptVector.toArray())
    rows = [[b, *map(float, w)] for b, w in zip(map(float, intercepts), weights)]
    if len(rows) == 1:
        rows = [[0.0] * len(rows[0]), *rows]
    if len(rows) != len(classes) or any(len(w) != len(features) + 1 for w in rows):
        raise ValueError("classes or features are not those of the model")
    flat = [(version, c, f, w) for c, ws in zip(classes, rows) for f, w in zip([INTERCEPT, *features], ws)]
    return literal_table(spark, flat, "model_version string, class string, feature string, weight double")


def score_by_table(df: DataFrame, table: DataFrame, features: Sequence[str], version: str = "model_version",
                   out: str = "probs", n_versions: int | None = None) -> DataFrame:
    """``df`` with the map ``out`` from class to probability, by the weights of the row's own version.

    NULL where a feature is NULL or the version has no weights; a feature the table does not name
    counts as weight zero.  An input column called ``out`` is replaced.
    """
    vectors = table.groupBy(F.col("model_version").alias(version), "class").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w"))
    packed = vectors.groupBy(version).agg(F.array_sort(F.collect_list(F.struct(
        "class", F.array(*[F.coalesce(F.col("w")[f], F.lit(0.0)) for f in [INTERCEPT, *features]]).alias("w")))).alias("__vectors"))
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    rows = join_bounded(df.withColumn("__x", x), packed, [version], "left", rows=n_versions)

    def margin(vector):
        return F.aggregate(F.zip_with(vector["w"], "__x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    rows = rows.withColumn("__m", F.transform("__vectors", margin))
    rows = rows.withColumn("__e", F.transform("__m", lambda m: F.exp(m - F.array_max("__m"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)
    whole = F.col("__vectors").isNotNull() & ~F.exists("__x", lambda v: v.isNull())
    probs = F.map_from_arrays(F.col("__vectors")["class"], F.transform("__e", lambda e: e / total))
    return rows.withColumn(out, F.when(whole, probs)).drop("__x", "__vectors", "__m", "__e")


def gradient(scored: DataFrame, features: Sequence[str], label: str = "label", probs: str = "probs") -> DataFrame:
    """``(class, feature, n, gradient)``: the mean of (outcome - probability) times the standardized feature.

    All zero at the optimum of an unregularized, unweighted fit on these rows; with an L2 penalty it is the
    penalty times the standardized weight there.  Rows without label or
    scores are left out; a constant feature has gradient 0.
    """
    given = scored.where(F.col(label).isNotNull() & F.col(probs).isNotNull())
    pairs = F.explode(F.map_entries(probs)).alias("__c")
    points = given.select(label, *features, pairs).select(
        F.col("__c.key").alias("class"), (F.col("__c.key").eqNullSafe(F.col(label).cast("string")).cast("double") - F.col("__c.value")).alias("__d"),
        F.explode(F.array(F.struct(F.lit(INTERCEPT).alias("feature"), F.lit(1.0).alias("x")),
                          *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("__f"))
    x, d = F.col("__f.x"), F.col("__d")
    sums = points.groupBy("class", F.col("__f.feature").alias("feature")).agg(
        F.count("*").alias("n"), F.avg(d * x).alias("dx"), F.avg(d).alias("d"), F.avg(x).alias("x"), F.stddev_pop(x).alias("s"))
    centred = F.when(F.col("feature") == INTERCEPT, F.col("d")).otherwise((F.col("dx") - F.col("d") * F.col("x")) / F.nullif("s", F.lit(0.0)))
    return sums.select("class", "feature", "n", F.coalesce(centred, F.lit(0.0)).alias("gradient"))
