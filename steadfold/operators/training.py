"""Candidate classifiers and versioned scoring on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("logistic", "forest", "boosted")


def train(df: DataFrame, family: str, features: Sequence[str], label: str = "label",
          classes: Sequence[str] | None = None, weight_col: str | None = None, seed: int = 7):
    """Fit one family as a PipelineModel with a ``probability`` output.

    The class order is given, not inferred, so that every version of a model writes its
    probabilities in the same order.  Rows without a label are left out.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import (
        GBTClassifier,
        LogisticRegression,
        OneVsRest,
        RandomForestClassifier,
    )
    from pyspark.ml.feature import StringIndexerModel, VectorAssembler

    if classes is None:
        raise ValueError("give the class list; its order fixes the probability vector")
    indexer = StringIndexerModel.from_labels(list(classes), inputCol=label, outputCol="__y", handleInvalid="skip")
    common = {"labelCol": "__y", "featuresCol": "__x"}
    weights = {"weightCol": weight_col} if weight_col else {}
    if family == "logistic":
        clf = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial", **common, **weights)
    elif family == "forest":
        clf = RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common, **weights)
    elif family == "boosted":
        gbt = GBTClassifier(maxIter=8, maxDepth=3, seed=seed, **common, **weights)
        clf = gbt if len(classes) == 2 else OneVsRest(classifier=gbt, **common, **weights)
    else:
        raise ValueError(f"unknown family {family!r}")
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error")
    labelled = indexer.transform(df.where(F.col(label).isNotNull()))
    return Pipeline(stages=[assembler, clf]).fit(labelled)


def score(df: DataFrame, model, version: str, classes: Sequence[str],
          keep: Sequence[str] = ("record_id", "label")) -> DataFrame:
    """Batch scores with a version tag: ``probs`` map and ``predicted`` class.

    One-vs-rest boosting has raw per-class margins only; they are turned into shares by a
    softmax and should be recalibrated before use as probabilities.
    """
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
        p = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    labels = F.array(*[F.lit(c) for c in classes])
    arr = out.withColumn("__p", p)
    return arr.select(
        *keep,
        F.lit(version).alias("model_version"),
        F.map_from_arrays(labels, "__p").alias("probs"),
        F.element_at(labels, F.array_position("__p", F.array_max("__p")).cast("int")).alias("predicted"),
    )


def retrain(adapt: DataFrame, family: str, features: Sequence[str], **kw):
    """Retrained candidate; pass the adapt split only, the gate uses the verify split."""
    return train(adapt, family, features, **kw)


def save_version(model, root: str, model_id: str, version: str) -> str:
    """Store a candidate under its version; an existing version is never overwritten."""
    path = f"{root}/{model_id}/version={version}"
    model.write().save(path)
    return path


def load_version(root: str, model_id: str, version: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{root}/{model_id}/version={version}")
