"""Maintenance decision: a fixed table of conditions, never a learned policy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reliability import PENDING_WORDING

NO_ACTION, RECALIBRATE, RETRAIN, HOLD = "NO_ACTION", "RECALIBRATE", "RETRAIN", "HOLD"


@dataclass(frozen=True)
class DecisionPolicy:
    """Every threshold of the decision; all of them are the user's to set."""

    max_bad_rate: float = 0.2
    shift_limit: float = 0.2
    perf_ok: float = 0.02
    perf_degraded: float = 0.05
    calibration_ok: float = 0.02
    calibration_degraded: float = 0.05
    min_labels_recalibrate: int = 100
    min_labels_retrain: int = 500
    min_class_labels_retrain: int = 50


def decide(evidence: DataFrame, policy: DecisionPolicy = DecisionPolicy()) -> DataFrame:
    """One action per evaluation window, conditions tried from the top.

    Evidence columns: ``bad_rate`` (data quality), ``shift`` (largest shift measure),
    ``n_labels``, ``min_class_labels``, ``perf_loss`` and ``calibration_loss`` (positive
    means worse than the baseline).
    """
    p = policy
    n_labels = F.coalesce(F.col("n_labels"), F.lit(0))
    severe = F.coalesce(F.col("bad_rate") > p.max_bad_rate, F.lit(False))
    shifted = F.coalesce(F.col("shift") > p.shift_limit, F.lit(False))
    unlabelled = (n_labels == 0) | F.col("perf_loss").isNull() | F.col("calibration_loss").isNull()
    perf_ok = F.col("perf_loss") <= p.perf_ok
    perf_bad = F.col("perf_loss") > p.perf_degraded
    cal_ok = F.col("calibration_loss") <= p.calibration_ok
    cal_bad = F.col("calibration_loss") > p.calibration_degraded
    can_fit = n_labels >= p.min_labels_recalibrate
    can_train = (n_labels >= p.min_labels_retrain) & (
        F.coalesce(F.col("min_class_labels"), F.lit(0)) >= p.min_class_labels_retrain
    )
    rule = (
        F.when(severe, 1)
        .when(unlabelled & shifted, 2)
        .when(unlabelled, 3)
        .when(perf_ok & cal_ok, 4)
        .when(perf_ok & cal_bad & can_fit, 5)
        .when(perf_bad & can_train, 6)
        .when(perf_bad | (perf_ok & cal_bad), 7)
        .otherwise(8)
    )
    r = F.col("rule")
    return evidence.withColumn("rule", rule).withColumns({
        "action": F.when(r.isin(3, 4), NO_ACTION).when(r == 5, RECALIBRATE).when(r == 6, RETRAIN).otherwise(HOLD),
        "reason": F.when(r == 1, "data quality severely compromised")
        .when(r == 2, PENDING_WORDING)
        .when(r == 3, "no shift; reliability unverified")
        .when(r == 4, "reliability within limits")
        .when(r == 5, "calibration degraded")
        .when(r == 6, "performance degraded")
        .when(r == 7, "degraded, labels insufficient for the action")
        .otherwise("ambiguous evidence"),
        "degraded_without_shift": r.isin(5, 6, 7) & ~shifted,
    })


def least_invasive(candidates: DataFrame, tau: float, key: Sequence[str] = ("window_id",)) -> DataFrame:
    """Cheapest action per window whose reliability reaches ``tau``; HOLD when none does.

    Candidates: ``(key, action, cost, reliability)``.  Among equal costs the first action
    name wins.
    """
    ok = F.coalesce(F.col("reliability") >= tau, F.lit(False))
    best = F.min(F.when(ok, F.struct("cost", "action", "reliability")))
    return candidates.groupBy(*key).agg(best.alias("b")).select(
        *key,
        F.coalesce("b.action", F.lit(HOLD)).alias("action"),
        F.col("b.cost").alias("cost"),
        F.col("b.reliability").alias("reliability"),
    )


def label_sufficiency(labels: DataFrame, classes: Sequence[str], min_total: int, min_per_class: int,
                      by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Label counts per group against the minimums; absent classes count as zero."""
    wide = labels.groupBy(*by).agg(
        F.count(label).alias("n_labels"),
        *[F.count_if(F.col(label) == F.lit(c)).alias(f"n_{c}") for c in classes],
    )
    smallest = F.least(*[F.col(f"n_{c}") for c in classes]) if len(classes) > 1 else F.col(f"n_{classes[0]}")
    return wide.withColumn("min_class_labels", smallest).withColumn(
        "sufficient", (F.col("n_labels") >= min_total) & (F.col("min_class_labels") >= min_per_class)
    )
