"""One round of the maintenance loop: monitor, assess, decide, adapt, verify, promote.

Bounded autonomy: the round can only choose among the predefined actions, a candidate is
fitted on the adapt split and judged on the verify split, and the registry is only ever
appended to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_bounded, materialize
from .adapt import apply_temperature, fit_temperature, next_version, temperature_grid
from .decide import HOLD, RECALIBRATE, RETRAIN, DecisionPolicy, decide, label_sufficiency
from .labels import fit_impute
from .reliability import degradation, label_coverage, metrics_long
from .shift import fit_edges, psi, to_long
from .training import retrain, score
from .verify import apply_gate, assert_disjoint, gate

KEY = "model_id"


@dataclass
class Round:
    """Tables of one round, ready for the report sinks, and the candidate if one was made."""

    shift_flags: DataFrame
    decision: DataFrame
    verdict: DataFrame | None
    registry: DataFrame
    action: str
    promoted: bool
    candidate: object | None = None


def maintenance_round(model, model_id: str, registry: DataFrame, baseline: DataFrame, reference: DataFrame,
                      window: DataFrame, features: Sequence[str], classes: Sequence[str], criteria: DataFrame,
                      ts, policy: DecisionPolicy = DecisionPolicy(), family: str = "logistic",
                      record_id: str = "record_id") -> Round:
    """Run the loop for one model on one window of records.

    ``reference`` holds the features the model was built on, ``baseline`` its frozen metrics
    ``(metric, class, value)``, ``window`` the new records with features, ``label`` (NULL
    while unknown) and ``split`` (adapt / verify).  Gaps in the features are filled with the
    reference means for scoring; the monitor sees them as gaps.  ``criteria`` is the gate of
    each action.
    Between deciding and adapting one row comes to the driver: the decision.
    """
    adapt_rows, verify_rows = window.where("split = 'adapt'"), window.where("split = 'verify'")
    means = fit_impute(reference, features)
    filled = lambda d: d.fillna(means)

    # monitor: inputs only, no labels needed
    sides = reference.select(F.lit("reference").alias("side"), *features).unionByName(
        adapt_rows.select(F.lit("current").alias("side"), *features))
    edges = fit_edges(to_long(sides, features, "side", windows=["reference"]), method="approx", group_bound=len(features))
    flags = materialize(psi(to_long(sides, features, "side"), edges, "reference", "side", group_bound=len(features)).withColumn(
        "shifted", F.coalesce(F.col("psi") > policy.shift_limit, F.lit(False))), "flags")

    # assess: only rows whose outcome is known
    keep = [record_id, "label", "split"]
    scored = materialize(score(filled(window), model, "active", classes, keep), "scored")
    seen = scored.where("split = 'adapt'")
    loss = degradation(metrics_long(seen, classes), baseline).agg(
        F.max(F.when(F.col("metric") == "macro_f1", F.col("degradation"))).alias("perf_loss"),
        F.max(F.when(F.col("metric") == "ece", F.col("degradation"))).alias("calibration_loss"))
    monitored = flags.agg(F.max("psi").alias("shift"), F.max("missing_rate").alias("bad_rate"))
    labels = label_sufficiency(seen, classes, policy.min_labels_retrain, policy.min_class_labels_retrain).select(
        "n_labels", "min_class_labels")
    one = [d.withColumn(KEY, F.lit(model_id)) for d in (monitored, loss, labels, label_coverage(seen).select("coverage"))]
    decision = materialize(decide(reduce(lambda a, b: join_bounded(a, b, [KEY], rows=1), one), policy), "decision")
    action = decision.first()["action"]
    if action not in (RECALIBRATE, RETRAIN):
        return Round(flags, decision, None, registry, action, False)

    # adapt on one split, verify on the other
    if not assert_disjoint(adapt_rows, verify_rows, record_id).first()["isolated"]:
        return Round(flags, decision.withColumn("action", F.lit(HOLD)), None, registry, HOLD, False)
    active = scored.where("split = 'verify'")
    if action == RECALIBRATE:
        made = fit_temperature(seen, classes, temperature_grid()).first()["temperature"]
        judged = apply_temperature(active, classes, made)
    else:
        made = retrain(filled(adapt_rows), family, features, classes=classes)
        judged = score(filled(verify_rows), made, "candidate", classes, keep)
    tagged = lambda d: metrics_long(d, classes).withColumn(KEY, F.lit(model_id))
    verdict = materialize(gate(tagged(judged).withColumn("action", F.lit(action)), tagged(active), criteria, [KEY]), "verdict")
    promoted = bool(verdict.first()["passed"])

    wanted = decision.select(KEY, F.lit(action).alias("action"))
    numbered = next_version(registry, wanted).where("version is not null").select(KEY, "version", "parent")
    judged_version = join_bounded(numbered, verdict.select(KEY, "passed"), [KEY], rows=1).withColumn(
        "ts", ts if hasattr(ts, "cast") else F.lit(ts))
    events = apply_gate(registry, judged_version)
    return Round(flags, decision, verdict, registry.unionByName(events), action, promoted, made if promoted else None)
