"""Verification gate and the append-only model registry.

Registry rows: ``(model_id, seq, version, parent, event, ts)`` with event CANDIDATE,
PROMOTED, REJECTED or ROLLBACK.  The active version is whatever the newest PROMOTED or
ROLLBACK event names; no row is ever changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_bounded
from .reliability import _direction

ACTIVATING = ("PROMOTED", "ROLLBACK")


def assert_disjoint(adapt: DataFrame, verify: DataFrame, record_id: str = "record_id") -> DataFrame:
    """One row ``(n_overlap, isolated)``: ids present on both sides of a split."""
    shared = adapt.select(record_id).distinct().join(verify.select(record_id).distinct(), record_id, "left_semi")
    return shared.agg(F.count("*").alias("n_overlap")).withColumn(
        "isolated", F.col("n_overlap") == 0
    )


def gate_detail(candidate: DataFrame, active: DataFrame, criteria: DataFrame,
                key: Sequence[str] = ("model_id",), n_criteria: int | None = None) -> DataFrame:
    """One row per (candidate, criterion) with its verdict.

    ``candidate``: ``(key, action, metric, class, value)``; ``active``: ``(key, metric,
    class, value)``; ``criteria``: ``(action, metric, class, kind, limit)`` where kind
    ``absolute`` bounds the value itself and ``relative`` bounds the loss against the
    active model.  A metric that is missing fails its criterion.
    """
    keys = ["action", "metric", "class"]
    wanted = candidate.select(*key, "action").distinct()
    todo = join_bounded(wanted, criteria, ["action"], rows=n_criteria)
    have = candidate.select(*key, *keys, F.col("value").alias("candidate_value"))
    base = active.select(*key, "metric", "class", F.col("value").alias("active_value"))
    joined = join_bounded(join_bounded(todo, have, [*key, *keys], "left"), base, [*key, "metric", "class"], "left")
    sign = _direction(F.col("metric"))
    absolute = (F.col("candidate_value") - F.col("limit")) * sign >= 0
    relative = (F.col("active_value") - F.col("candidate_value")) * sign <= F.col("limit")
    return joined.withColumn(
        "passed", F.coalesce(F.when(F.col("kind") == "absolute", absolute).otherwise(relative), F.lit(False))
    )


def gate(candidate: DataFrame, active: DataFrame, criteria: DataFrame,
         key: Sequence[str] = ("model_id",), n_criteria: int | None = None) -> DataFrame:
    """PASS only when every predefined criterion of the action holds."""
    detail = gate_detail(candidate, active, criteria, key, n_criteria)
    return detail.groupBy(*key, "action").agg(
        F.count("*").alias("n_criteria"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.bool_and("passed").alias("passed"),
    )


def _next_seq(registry: DataFrame, key: Sequence[str]) -> DataFrame:
    return registry.groupBy(*key).agg(F.max("seq").alias("__seq"))


def apply_gate(registry: DataFrame, verdicts: DataFrame, key: Sequence[str] = ("model_id",)) -> DataFrame:
    """Events to append for judged candidates: PROMOTED or REJECTED.

    ``verdicts``: ``(key, version, parent, passed, ts)``.  A rejection leaves the active
    version as it is because it names no new active version.
    """
    order = Window.partitionBy(*key).orderBy("ts", "version")
    return join_bounded(verdicts, _next_seq(registry, key), key, "left").select(
        *key,
        (F.coalesce(F.col("__seq"), F.lit(0)) + F.row_number().over(order)).cast("bigint").alias("seq"),
        "version",
        "parent",
        F.when(F.coalesce(F.col("passed"), F.lit(False)), "PROMOTED").otherwise("REJECTED").alias("event"),
        "ts",
    )


def active_version(registry: DataFrame, as_of=None, key: Sequence[str] = ("model_id",)) -> DataFrame:
    """Active version per model, now or as of a time."""
    events = registry.where(F.col("event").isin(*ACTIVATING))
    if as_of is not None:
        events = events.where(F.col("ts") <= F.lit(as_of))
    return events.groupBy(*key).agg(F.max(F.struct("seq", "version", "ts")).alias("__a")).select(
        *key, F.col("__a.version").alias("active_version"), F.col("__a.ts").alias("active_since")
    )


def rollback(registry: DataFrame, ts, key: Sequence[str] = ("model_id",)) -> DataFrame:
    """ROLLBACK events that restore the version promoted before the active one.

    A rollback takes back the promotions of a version before it, not those after it: a version
    promoted again counts again.  Models without another standing version get no event.
    """
    order = Window.partitionBy(*key).orderBy("seq")
    withdrawn = registry.where(F.col("event") == "ROLLBACK").groupBy(
        *key, F.col("parent").alias("version")).agg(F.max("seq").alias("__gone"))
    standing = (
        registry.where(F.col("event") == "PROMOTED")
        .groupBy(*key, "version").agg(F.max("seq").alias("seq"))
        .join(withdrawn, [*key, "version"], "left")
        .where(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone")))
        .withColumn("__prev", F.lag("version").over(order))
    )
    current = standing.groupBy(*key).agg(F.max(F.struct("seq", "version", "__prev")).alias("a"))
    return join_bounded(current.where(F.col("a.__prev").isNotNull()), _next_seq(registry, key), key).select(
        *key,
        (F.col("__seq") + 1).cast("bigint").alias("seq"),
        F.col("a.__prev").alias("version"),
        F.col("a.version").alias("parent"),
        F.lit("ROLLBACK").alias("event"),
        (ts if hasattr(ts, "cast") else F.lit(ts)).alias("ts"),
    )


def version_history(registry: DataFrame, key: Sequence[str] = ("model_id",)) -> DataFrame:
    """Validity interval of every activation; the open one has no end."""
    order = Window.partitionBy(*key).orderBy("seq")
    return registry.where(F.col("event").isin(*ACTIVATING)).select(
        *key,
        "version",
        "event",
        F.col("ts").alias("valid_from"),
        F.lead("ts").over(order).alias("valid_to"),
        F.row_number().over(order).alias("activation"),
    )
