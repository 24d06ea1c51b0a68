"""Comparison of maintenance strategies under the stress scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..session import join_bounded, literal_table, materialize
from .adapt import apply_temperature, fit_temperature, temperature_grid
from .decide import HOLD, NO_ACTION, RECALIBRATE, RETRAIN, DecisionPolicy, decide
from .reliability import METRIC_DIRECTION, degradation, metrics_long
from .scenarios import Scenario, apply_manifest
from .shift import fit_edges, missingness, psi, to_long
from .training import score, train
from .verify import gate

STRATEGIES = ("static", "always_recalibrate", "always_retrain", "adaptive")
INTERVENTIONS = (RECALIBRATE, RETRAIN)


def run_strategies(data: DataFrame, manifest: Sequence[Scenario], features: Sequence[str],
                   classes: Sequence[str], criteria: DataFrame, fill: Mapping[str, float],
                   policy: DecisionPolicy = DecisionPolicy(), family: str = "logistic",
                   record_id: str = "record_id") -> DataFrame:
    """Four strategies over all scenarios, as one long results table.

    ``data`` holds ``record_id, label, split`` (reference / adapt / verify) and the
    features.  The reference split trains the frozen model; scenarios stress the other two;
    adaptation sees the adapt split only and every metric is taken on the verify split.
    Only the decision of each scenario comes back to the driver, because it says which
    models to fit; scoring and metrics are single jobs over all scenarios.

    Output: ``(scenario, strategy, phase, metric, class, value, action, gate)``.  The fixed
    strategies act on the shift condition and promote without a gate.
    """
    tags = ["scenario"]
    reference = data.where("split = 'reference'")
    filled = lambda d: d.fillna(dict(fill))
    frozen = train(filled(reference), family, features, classes=classes)

    stressed = materialize(apply_manifest(data.where("split in ('adapt', 'verify')"), manifest, record_id), "stressed")
    keep = [record_id, "label", "split", "scenario"]
    scored = materialize(score(filled(stressed), frozen, "1.0", classes, keep), "scored")

    # monitor: PSI and missingness of the unlabelled inputs against the reference split
    windows = reference.withColumn("scenario", F.lit("(reference)")).select("scenario", *features).unionByName(
        stressed.where("split = 'adapt'").select("scenario", *features))
    long = to_long(windows, features, "scenario")
    edges = fit_edges(long.where("scenario = '(reference)'"), method="approx", group_bound=len(features))
    shift = psi(long, edges, "(reference)", "scenario", group_bound=len(features)).groupBy("scenario").agg(
        F.max("psi").alias("shift"))
    bad = missingness(windows, features, "(reference)", "scenario").groupBy("scenario").agg(
        F.max("missing_change").alias("bad_rate"))

    # assess on the adapt split: loss against the unstressed baseline
    bound = len(manifest) + 2
    seen = materialize(
        metrics_long(scored.where("split = 'adapt'"), classes, by=tags, group_bound=len(classes) * bound), "seen")
    loss = degradation(seen, seen.where("scenario = 'none'")).groupBy("scenario").agg(
        F.max(F.when(F.col("metric") == "macro_f1", F.col("degradation"))).alias("perf_loss"),
        F.max(F.when(F.col("metric") == "ece", F.col("degradation"))).alias("calibration_loss"))
    labelled = scored.where("split = 'adapt'").groupBy("scenario", "label").agg(F.count("label").alias("n"))
    sizes = labelled.groupBy("scenario").agg(F.sum("n").alias("n_labels"), F.min("n").alias("min_class_labels"))
    evidence = reduce(lambda a, b: join_bounded(a, b, tags, "left", rows=bound), [shift, bad, loss, sizes])
    decided = {r["scenario"]: r for r in decide(evidence, policy).select(
        "scenario", "action", "shift", F.coalesce(F.col("shift") > policy.shift_limit, F.lit(False)).alias("fired"),
    ).collect()}

    # adapt: one temperature per scenario in one job, one fit per scenario that retrains
    temps = {r["scenario"]: r["temperature"] for r in fit_temperature(
        scored.where("split = 'adapt'"), classes, temperature_grid(), by=tags).collect()}
    verify = scored.where("split = 'verify'")
    temp_col = F.create_map(*[F.lit(x) for kv in temps.items() for x in kv])[F.col("scenario")]
    recalibrated = apply_temperature(verify, classes, F.coalesce(temp_col, F.lit(1.0))).withColumn("model_version", F.lit("1.1"))
    retrain_in = [s for s, r in decided.items() if r["fired"] or r["action"] == RETRAIN]
    retrained = None
    for name in retrain_in:
        mine = filled(stressed.where(F.col("scenario") == name))
        model = train(mine.where("split = 'adapt'"), family, features, classes=classes)
        part = score(mine.where("split = 'verify'"), model, "2.0", classes, keep)
        retrained = part if retrained is None else retrained.unionByName(part)
    if retrained is None:
        retrained = verify.limit(0).withColumn("model_version", F.lit("2.0"))

    by = [*tags, "model_version"]
    versions = materialize(verify.unionByName(recalibrated).unionByName(retrained), "versions")
    measured = materialize(metrics_long(versions, classes, by=by, group_bound=3 * len(classes) * bound), "measured")

    # verify: gate the adaptive strategy's candidates
    spark = data.sparkSession
    chosen = literal_table(spark, [(s, r["action"]) for s, r in decided.items()], "scenario string, chosen string")
    version_of = F.when(F.col("chosen") == RECALIBRATE, "1.1").when(F.col("chosen") == RETRAIN, "2.0")
    candidate = join_bounded(measured, chosen, tags, rows=bound).where(F.col("model_version") == version_of).select(
        "scenario", F.col("chosen").alias("action"), "metric", "class", "value")
    active = measured.where("model_version = '1.0'").drop("model_version")
    verdict = gate(candidate, active, criteria, key=tags).select("scenario", "passed")

    plan = []
    for s, r in decided.items():
        plan += [
            (s, "static", NO_ACTION, "1.0"),
            (s, "always_recalibrate", RECALIBRATE if r["fired"] else NO_ACTION, "1.1" if r["fired"] else "1.0"),
            (s, "always_retrain", RETRAIN if r["fired"] else NO_ACTION, "2.0" if r["fired"] else "1.0"),
            (s, "adaptive", r["action"], {RECALIBRATE: "1.1", RETRAIN: "2.0"}.get(r["action"], "1.0")),
        ]
    plans = literal_table(spark, plan, "scenario string, strategy string, action string, wanted string")
    plans = join_bounded(plans, verdict, tags, "left", rows=bound)
    is_candidate = (F.col("strategy") == "adaptive") & F.col("action").isin(*INTERVENTIONS)
    plans = plans.select(
        "scenario", "strategy", "action",
        F.when(is_candidate, F.when(F.coalesce("passed", F.lit(False)), "PASS").otherwise("FAIL")).otherwise("NONE").alias("gate"),
        F.when(is_candidate & ~F.coalesce("passed", F.lit(False)), "1.0").otherwise(F.col("wanted")).alias("model_version"),
    )
    cols = ["scenario", "strategy", "phase", "metric", "class", "value", "action", "gate"]
    after = join_bounded(measured, plans, by, rows=4 * bound).withColumn("phase", F.lit("after"))
    frozen_rows = measured.where("model_version = '1.0'").drop("model_version")
    names = plans.select("scenario", "strategy", "action", "gate")
    degraded = join_bounded(names, frozen_rows, tags).withColumn("phase", F.lit("degraded"))
    original = join_bounded(names.withColumn("__one", F.lit("none")),
                            frozen_rows.where("scenario = 'none'").withColumnRenamed("scenario", "__one"),
                            ["__one"]).withColumn("phase", F.lit("original"))
    return after.select(*cols).unionByName(degraded.select(*cols)).unionByName(original.select(*cols))


def recovery(results: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(after - degraded) / (original - degraded) per scenario, strategy, metric and class.

    The ratio has the same meaning for metrics where lower is better.  NULL when nothing
    was lost, or when the scenario made the metric better.
    """
    phase = lambda p: F.max(F.when(F.col("phase") == p, F.col("value"))).alias(p)
    wide = results.groupBy("scenario", "strategy", "metric", "class").agg(
        phase("original"), phase("degraded"), phase("after"))
    lower = [m for m, d in METRIC_DIRECTION.items() if d < 0]
    lost = (F.col("original") - F.col("degraded")) * F.when(F.col("metric").isin(lower), -1.0).otherwise(1.0)
    return wide.withColumn(
        "recovery",
        F.when(lost > eps, safe_ratio(F.col("after") - F.col("degraded"), F.col("original") - F.col("degraded"))),
    )


def unnecessary_rate(actions: DataFrame) -> DataFrame:
    """Interventions made although the status before was ok, over all interventions."""
    acted = F.col("action").isin(*INTERVENTIONS)
    return actions.groupBy("strategy").agg(
        F.count_if(acted).alias("n_interventions"),
        F.count_if(acted & (F.col("pre_status") == "ok")).alias("n_unnecessary"),
    ).withColumn("unnecessary_rate", safe_ratio(F.col("n_unnecessary"), F.col("n_interventions")))


def failed_adaptation_rate(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("strategy").agg(
        F.count("*").alias("n_candidates"), F.count_if(~F.col("passed")).alias("n_failed"),
    ).withColumn("failed_rate", safe_ratio(F.col("n_failed"), F.col("n_candidates")))


def rollback_success_rate(events: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Rejected or rolled-back rows after which the retained version performs as before."""
    backed = events.where(F.col("event").isin("REJECTED", "ROLLBACK"))
    same = F.coalesce(F.abs(F.col("later_value") - F.col("retained_value")) <= eps, F.lit(False))
    return backed.groupBy("strategy").agg(
        F.count("*").alias("n_rollbacks"), F.count_if(same).alias("n_restored"),
    ).withColumn("rollback_success_rate", safe_ratio(F.col("n_restored"), F.col("n_rollbacks")))


def maintenance_cost(actions: DataFrame, costs: Mapping[str, float]) -> DataFrame:
    """How often each strategy acted and what that cost; unknown actions cost nothing."""
    cost = F.lit(0.0)
    for a, c in costs.items():
        cost = F.when(F.col("action") == a, F.lit(float(c))).otherwise(cost)
    return actions.groupBy("strategy").agg(
        F.count("*").alias("n_windows"),
        F.count_if(F.col("action").isin(*INTERVENTIONS)).alias("n_interventions"),
        F.count_if(F.col("action") == HOLD).alias("n_holds"),
        F.sum(cost).alias("total_cost"),
    ).withColumn("frequency", safe_ratio(F.col("n_interventions"), F.col("n_windows")))


def strategy_comparison(recovered: DataFrame, actions: DataFrame, metric: str,
                        strategies: Sequence[str] = STRATEGIES) -> tuple[DataFrame, DataFrame]:
    """Recovery by scenario with one column per strategy, and the overall ranking.

    The ranking runs over one row per strategy.
    """
    mine = recovered.where(F.col("metric") == metric)
    table = mine.groupBy("scenario", "class").pivot("strategy", list(strategies)).agg(F.avg("recovery"))
    acted = actions.groupBy("strategy").agg(F.count_if(F.col("action").isin(*INTERVENTIONS)).alias("n_interventions"))
    mean = mine.groupBy("strategy").agg(F.avg("recovery").alias("mean_recovery"))
    both = join_bounded(mean, acted, ["strategy"], "left").withColumn("__one", F.lit(1))
    w = Window.partitionBy("__one")
    ranking = both.select(
        "strategy", "mean_recovery", F.coalesce("n_interventions", F.lit(0)).alias("n_interventions"),
        F.rank().over(w.orderBy(F.col("mean_recovery").desc_nulls_last())).alias("recovery_rank"),
        F.rank().over(w.orderBy(F.coalesce("n_interventions", F.lit(0)))).alias("intervention_rank"),
    )
    return table, ranking
