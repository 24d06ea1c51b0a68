"""Curation, derived age, coverage and linkage audits, context joins, frozen splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_mille, safe_ratio
from ..session import join_bounded


def curate(df: DataFrame, casts: Mapping[str, str], rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Raw strings to typed rows: trim, cast, domain-check, quarantine.

    ``casts`` maps a string column to its type; ``rules`` maps a rule name to the condition
    that must hold on the typed row (NULL counts as holding: absence is reported by the
    missingness monitor).  Returns ``(clean, rejects)``; rejects keep the raw text and say
    which rules failed.
    """
    trimmed = df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in casts})
    typed = trimmed.withColumns({f"__raw_{c}": F.col(c) for c in casts}).withColumns(
        {c: F.col(c).try_cast(t) for c, t in casts.items()}
    )
    failures = [
        F.when(F.col(f"__raw_{c}").isNotNull() & F.col(c).isNull(), F.lit(f"{c}: not {t}")) for c, t in casts.items()
    ]
    failures += [F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    judged = typed.withColumn("failed_rules", F.array_compact(F.array(*failures)))
    others = [c for c in df.columns if c not in casts]
    clean = judged.where(F.size("failed_rules") == 0).select(*df.columns)
    rejects = judged.where(F.size("failed_rules") > 0).select(
        *others, *[F.col(f"__raw_{c}").alias(c) for c in casts], "failed_rules"
    )
    return clean, rejects


def with_age(df: DataFrame, birth: str = "birth_date", measured: str = "measured_on",
             out: str = "age_months") -> DataFrame:
    """Completed months between birth and measurement; NULL when measured before birth."""
    months = F.floor(F.months_between(F.col(measured).cast("date"), F.col(birth).cast("date"))).cast("int")
    return df.withColumn(out, F.when(months >= 0, months))


def coverage(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("snapshot_year",)) -> DataFrame:
    """How many rows hold each feature, per year (and area).  One pass, one row per feature."""
    wide = df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count(f).alias(f) for f in features])
    return wide.unpivot([*by, "n_rows"], list(features), "feature", "n_present").withColumn(
        "coverage", safe_ratio(F.col("n_present"), F.col("n_rows"))
    )


def covered_features(cov: DataFrame, year, min_coverage: float, year_col: str = "snapshot_year") -> DataFrame:
    return cov.where((F.col(year_col) == F.lit(year)) & (F.col("coverage") >= min_coverage)).select("feature")


def feature_overlap(cov: DataFrame, year_a, year_b, min_coverage: float = 0.5,
                    year_col: str = "snapshot_year") -> DataFrame:
    """Features comparable in both years, and those only one of them holds."""
    a = covered_features(cov, year_a, min_coverage, year_col)
    b = covered_features(cov, year_b, min_coverage, year_col)
    tag = lambda d, t: d.select("feature", F.lit(t).alias("membership"))
    return (
        tag(a.intersect(b), "common")
        .unionByName(tag(a.exceptAll(b), f"only {year_a}"))
        .unionByName(tag(b.exceptAll(a), f"only {year_b}"))
    )


def distinct_areas(df: DataFrame, areas: Sequence[str], by: Sequence[str] = ("snapshot_year",)) -> DataFrame:
    """Number of different areas per year: a plain bound on geographic claims."""
    return df.groupBy(*by).agg(*[F.count_distinct(a).alias(f"n_{a}") for a in areas])


def linkage(df: DataFrame, record_id: str, year: str = "snapshot_year") -> DataFrame:
    """How many ids occur in 1, 2, ... snapshots.  All in 1 means no longitudinal use."""
    per_id = df.select(record_id, year).distinct().groupBy(record_id).agg(F.count("*").alias("n_years"))
    return per_id.groupBy("n_years").agg(F.count("*").alias("n_ids"))


def with_context(df: DataFrame, context: DataFrame, keys: Sequence[str], lag_years: int = 0,
                 year: str = "year", n_context: int | None = None) -> DataFrame:
    """Left join yearly (or year and area) context, optionally of ``lag_years`` before.

    ``n_context`` is the row bound of the context table (years x areas) if known.
    """
    dim = context
    if lag_years:
        dim = dim.withColumn(year, F.col(year) + lag_years)
        dim = dim.select(*keys, *[F.col(c).alias(f"{c}_lag{lag_years}") for c in dim.columns if c not in keys])
    return join_bounded(df, dim, keys, "left", rows=n_context)


def effective_n(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows against distinct values of each context column: repeats are not observations.

    Distinct values are combined map-side first, so a yearly constant costs one row per task.
    """
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "feature", "value"
    )
    per_value = long.groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy(*by, "feature").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct_context")
    )


def assign_split(df: DataFrame, record_id: str, weights: Mapping[str, int], seed: str,
                 out: str = "split") -> DataFrame:
    """Frozen split by a hash of the id: the same id always lands in the same split.

    ``weights`` are per mille in order and must add up to 1000.
    """
    if sum(weights.values()) != 1000:
        raise ValueError("split weights are per mille and must add up to 1000")
    h = hash_mille(seed, F.col(record_id))
    split, top = None, 0
    for name, w in weights.items():
        top += w
        split = F.when(h < top, name) if split is None else split.when(h < top, name)
    return df.withColumn(out, split)
