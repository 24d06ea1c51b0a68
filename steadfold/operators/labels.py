"""Indicators, outcome categories, leakage guard and feature preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from .reliability import ranking_metrics
from .shift import to_long

INDICATORS = ("stunted", "wasted", "underweight")
CATEGORIES = ("Normal", "MAM", "SAM")


def indicator_overlap(df: DataFrame, indicators: Sequence[str] = INDICATORS) -> DataFrame:
    """Counts for every combination of the indicators with all marginals (cube).

    ``level`` is the grouping id: a set bit marks an indicator that was summed over, which
    tells a marginal apart from a recorded NULL.
    """
    return df.cube(*indicators).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def label_crosstab(df: DataFrame, category: str = "category", categories: Sequence[str] = CATEGORIES,
                   indicators: Sequence[str] = INDICATORS) -> DataFrame:
    """Indicator combination x operational category.

    ``n_abnormal_not_case`` counts children with a growth indicator whose recorded category
    is not one of the operational cases (all categories but the first).
    """
    cases = list(categories[1:])
    abnormal = reduce(or_, [F.coalesce(F.col(i), F.lit(False)) for i in indicators])
    # the pivot over a fixed class list, written as one aggregation so the row totals need no second pass
    return df.groupBy(*indicators).agg(
        *[F.count_if(F.col(category) == F.lit(c)).alias(f"n_{c}") for c in categories],
        F.count("*").alias("n"),
        F.count_if(abnormal & ~F.coalesce(F.col(category).isin(cases), F.lit(False))).alias("n_abnormal_not_case"),
    )


def class_balance(df: DataFrame, label: str = "category", year: str = "snapshot_year") -> DataFrame:
    """Class counts and shares per snapshot; the window runs over class counts, not rows."""
    w = Window.partitionBy(year)
    return df.groupBy(year, F.col(label).alias("class")).agg(F.count("*").alias("n")).select(
        year, "class", "n",
        safe_ratio(F.col("n"), F.sum("n").over(w)).alias("share"),
        F.row_number().over(w.orderBy("n", "class")).alias("rarity"),
    )


def select_upstream(df: DataFrame, roles: Mapping[str, str], keep_roles: Sequence[str] = ("id", "upstream"),
                    target: str | None = None) -> DataFrame:
    """Project to upstream predictors (and the target).  A column without a role is an error."""
    unknown = [c for c in df.columns if c not in roles and c != target]
    if unknown:
        raise ValueError(f"columns without a declared role: {unknown}")
    kept = [c for c in df.columns if roles.get(c) in keep_roles and c != target]
    return df.select(*kept, *([target] if target else []))


def role_leaks(features: Sequence[str], roles: Mapping[str, str],
               forbidden: Sequence[str] = ("anthropometric", "outcome")) -> list[str]:
    """Declared-role half of the leakage guard: predictors that define the target."""
    return [f for f in features if roles.get(f, "unknown") in (*forbidden, "unknown")]


def leakage_report(df: DataFrame, label: str, features: Sequence[str], limit: float,
                   roles: Mapping[str, str] | None = None) -> DataFrame:
    """Single-feature separability of a 0/1 label, one job for all features.

    ``separability`` is max(AUROC, 1 - AUROC).  Suspect when it exceeds ``limit`` or when
    the feature's declared role forbids it.
    """
    long = to_long(df.where(F.col(label).isNotNull()), features, label).select(
        F.col("feature").alias("class"), F.col("value").alias("score"), F.col(label).cast("int").alias("y")
    )
    ranked = ranking_metrics(long, group_bound=len(features))
    sep = F.greatest(F.col("auroc"), 1 - F.col("auroc"))
    bad = role_leaks(features, roles) if roles is not None else []
    return ranked.select(
        F.col("class").alias("feature"), "n_pos", "n_neg", "auroc", sep.alias("separability"),
        (F.coalesce(sep > limit, F.lit(False)) | F.col("class").isin(bad)).alias("suspect"),
    )


def fit_impute(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Means of the split given (pass the reference split only).  One row comes back."""
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: row[f] for f in features}


def impute(df: DataFrame, stats: Mapping[str, float]) -> DataFrame:
    """Fill with the fitted statistics and keep a ``<feature>_missing`` indicator."""
    flagged = df.withColumns({f"{f}_missing": F.col(f).isNull().cast("int") for f in stats})
    return flagged.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in stats.items()})


def select_family(results: DataFrame, metric: str, higher_is_better: bool = True,
                  by: Sequence[str] = ()) -> DataFrame:
    """Best model family by a held-out metric; ties go to the first name."""
    value = F.col("value").desc_nulls_last() if higher_is_better else F.col("value").asc_nulls_last()
    keys = list(by) or ["metric"]
    ranked = results.where(F.col("metric") == metric).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(value, "family"))
    )
    return ranked.where("__rn = 1").drop("__rn")
