"""Candidate generation: recalibration, reweighting, version numbers.

Model training itself is in ``training``.  Nothing here changes an active model:
every function yields a candidate table that the gate has to pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..session import join_bounded

CLIP = 1e-12


def temperature_grid(low: float = 0.05, high: float = 20.0, n: int = 41) -> list[float]:
    """Geometric grid around 1."""
    return [round(low * (high / low) ** (i / (n - 1)), 6) for i in range(n)]


def fit_temperature(scored: DataFrame, classes: Sequence[str], grid: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Temperature with the smallest mean negative log likelihood.

    The grid is a literal array exploded next to each row and combined map-side, so only
    |grid| partial sums per task are shuffled.  ``on_edge`` warns that the best value is
    the first or last of the grid and the grid should be widened.
    """
    nll = temperature_nll(scored, classes, grid, by)
    keys = list(by) or ["__one"]
    ranked = (nll if by else nll.withColumn("__one", F.lit(1))).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("nll", "temperature"))
    )
    return ranked.where("__rn = 1").select(
        *by, "temperature", "nll", "n",
        F.col("temperature").isin(float(min(grid)), float(max(grid))).alias("on_edge"),
    )


def temperature_nll(scored: DataFrame, classes: Sequence[str], grid: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log likelihood at every grid temperature."""
    logs = [F.ln(F.greatest(F.col("probs")[F.lit(c)], F.lit(CLIP))).alias(f"z{i}") for i, c in enumerate(classes)]
    zy: Column = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        zy = F.when(F.col("label") == F.lit(c), F.col(f"z{i}")).otherwise(zy)
    total: Column = F.lit(0.0)
    for i in range(len(classes)):
        total = total + F.exp(F.col(f"z{i}") / F.col("temperature"))
    return (
        scored.where(F.col("label").isNotNull())
        .select(*by, "label", *logs)
        .select(*by, zy.alias("zy"), *[f"z{i}" for i in range(len(classes))],
                F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
        .groupBy(*by, "temperature")
        .agg(F.avg(F.ln(total) - F.col("zy") / F.col("temperature")).alias("nll"), F.count("*").alias("n"))
    )


def apply_temperature(scored: DataFrame, classes: Sequence[str], temperature: Column | float) -> DataFrame:
    """Rescale ``probs``; the ranking of the classes, hence ``predicted``, cannot change."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = [F.pow(F.greatest(F.col("probs")[F.lit(c)], F.lit(CLIP)), 1.0 / t) for c in classes]
    total: Column = F.lit(0.0)
    for p in powers:
        total = total + p
    entries: list[Column] = []
    for c, p in zip(classes, powers):
        entries += [F.lit(c), p / total]
    return scored.withColumn("probs", F.create_map(*entries))


def score_bins(ovr: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Bounded summary of a binary score: (bin, mean score, mean outcome, weight)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return ovr.where(F.col("y").isNotNull() & F.col("score").isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.avg("score").alias("score"), F.avg("y").alias("rate"), F.count("*").cast("double").alias("weight")
    )


def fit_isotonic(ovr: DataFrame, bins: int = 100):
    """Isotonic regression on binned scores (at most ``bins`` weighted points).

    Returns the fitted model and the calibrated bin table.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    points = VectorAssembler(inputCols=["score"], outputCol="features").transform(score_bins(ovr, bins))
    model = IsotonicRegression(labelCol="rate", weightCol="weight", featuresCol="features",
                               predictionCol="calibrated").fit(points)
    return model, model.transform(points).drop("features")


def apply_isotonic(df: DataFrame, model, score: str = "score", out: str = "calibrated") -> DataFrame:
    """Calibrated score of every row, interpolated between the fitted points."""
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=[score], outputCol="__f", handleInvalid="keep").transform(df)
    return model.setFeaturesCol("__f").setPredictionCol(out).transform(vec).drop("__f")


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(q / (1 - q))


def fit_platt(ovr: DataFrame):
    """Platt scaling: logistic regression of the outcome on the score's logit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = ovr.where(F.col("y").isNotNull()).select(
        logit(F.col("score")).alias("logit"), F.col("y").cast("double").alias("y"))
    vec = VectorAssembler(inputCols=["logit"], outputCol="features").transform(data)
    model = LogisticRegression(labelCol="y", featuresCol="features", regParam=0.0, maxIter=100).fit(vec)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(df: DataFrame, a: float, b: float, score: str = "score", out: str = "calibrated") -> DataFrame:
    return df.withColumn(out, 1 / (1 + F.exp(-(F.lit(a) * logit(F.col(score)) + F.lit(b)))))


def reweight(ref: DataFrame, current: DataFrame, strata: Sequence[str], weight: str = "weight",
             n_strata: int | None = None) -> DataFrame:
    """Weight reference rows so that their strata have the current window's shares.

    A stratum without current rows gets weight 0.  Strata are counted on each side first,
    so a huge stratum is never shuffled as rows.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*strata).agg(F.count("*").alias(name))

    r = counted(ref, "nr")
    c = counted(current, "nc")
    both = join_bounded(r, c, strata, "left", rows=n_strata).withColumn("__one", F.lit(1))
    totals = r.agg(F.sum("nr").alias("tr")).withColumn("__one", F.lit(1))
    ctotal = c.agg(F.sum("nc").alias("tc")).withColumn("__one", F.lit(1))
    shares = join_bounded(join_bounded(both, totals, ["__one"], rows=1), ctotal, ["__one"], rows=1).select(
        *strata,
        safe_ratio(F.coalesce(F.col("nc"), F.lit(0)) * F.col("tr"), F.col("tc") * F.col("nr")).alias(weight),
    )
    return join_bounded(ref, shares, strata, "left", rows=n_strata)


def next_version(registry: DataFrame, actions: DataFrame, key: Sequence[str] = ("model_id",)) -> DataFrame:
    """Version number of each requested candidate: minor step for RECALIBRATE, major for RETRAIN.

    Numbers already used by rejected candidates are not reused.  An action that cannot be numbered
    stays, without a version and with a ``reason``.
    """
    parts = registry.select(
        *key,
        F.split_part("version", F.lit("."), F.lit(1)).cast("int").alias("major"),
        F.split_part("version", F.lit("."), F.lit(2)).cast("int").alias("minor"),
        "version", "event", "seq",
    )
    by_major = parts.groupBy(*key, "major").agg(
        F.max("minor").alias("minor"),
        F.max(F.when(F.col("event").isin("PROMOTED", "ROLLBACK"), F.struct("seq", "major", "version"))).alias("act"))
    state = by_major.groupBy(*key).agg(
        F.max("major").alias("top_major"), F.max("act").alias("act"), F.max_by("minor", F.col("act.seq")).alias("used_minor"))
    numbered = join_bounded(actions, state, key, "left")
    return numbered.select(
        *key,
        "action",
        F.col("act.version").alias("parent"),
        F.when(F.col("action") == "RECALIBRATE", F.concat(F.col("act.major"), F.lit("."), F.col("used_minor") + 1))
        .when(F.col("action") == "RETRAIN", F.concat(F.col("top_major") + 1, F.lit(".0")))
        .alias("version"),
        F.when(F.col("top_major").isNull(), "unknown model")
        .when((F.col("action") == "RECALIBRATE") & F.col("act").isNull(), "no active version").alias("reason"),
    )
