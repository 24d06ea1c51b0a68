from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from steadfold.operators import adapt, decide, experiment, verify
from steadfold.operators.reliability import PENDING_WORDING
from steadfold.schemas import GATE_CRITERIA

P = decide.DecisionPolicy(max_bad_rate=0.2, shift_limit=0.2, perf_ok=0.02, perf_degraded=0.05, calibration_ok=0.02,
                          calibration_degraded=0.05, min_labels_recalibrate=100, min_labels_retrain=500, min_class_labels_retrain=50)
COLUMNS = "bad_rate double, shift double, n_labels int, min_class_labels int, perf_loss double, calibration_loss double"
CASES = [
    # bad, shift, labels, per class, perf, cal -> rule, action, degraded without shift
    ((0.5, 0.9, 900, 90, 0.9, 0.9), 1, "HOLD", False),
    ((0.0, 0.9, 0, None, None, None), 2, "HOLD", False),
    ((0.0, 0.9, 900, 90, None, 0.0), 2, "HOLD", False),
    ((0.0, 0.1, 0, None, None, None), 3, "NO_ACTION", False),
    ((0.0, 0.9, 900, 90, 0.0, 0.0), 4, "NO_ACTION", False),
    ((0.0, 0.1, 900, 90, -0.1, 0.0), 4, "NO_ACTION", False),
    ((0.0, 0.9, 100, 10, 0.0, 0.2), 5, "RECALIBRATE", False),
    ((0.0, 0.9, 500, 50, 0.2, 0.0), 6, "RETRAIN", False),
    ((0.0, 0.0, 500, 50, 0.2, 0.2), 6, "RETRAIN", True),
    ((0.0, 0.9, 500, 49, 0.2, 0.0), 7, "HOLD", False),
    ((0.0, 0.9, 99, 50, 0.0, 0.2), 7, "HOLD", False),
    ((0.0, 0.9, 900, 90, 0.03, 0.0), 8, "HOLD", False),
    ((0.0, 0.9, 900, 90, 0.0, 0.04), 8, "HOLD", False),
    ((None, None, 900, 90, 0.0, 0.0), 4, "NO_ACTION", False),
]


@pytest.mark.parametrize("evidence, rule, action, unshifted", CASES)
def test_decision_table(spark, evidence, rule, action, unshifted):
    row = decide.decide(spark.createDataFrame([evidence], COLUMNS), P).first()
    assert (row["rule"], row["action"], row["degraded_without_shift"]) == (rule, action, unshifted)
    if rule == 2:
        assert row["reason"] == PENDING_WORDING


def test_least_invasive_prefers_the_cheapest_sufficient_action(spark):
    df = spark.createDataFrame([
        ("a", "NO_ACTION", 0.0, 0.7), ("a", "RECALIBRATE", 1.0, 0.85), ("a", "RETRAIN", 5.0, 0.95),
        ("b", "NO_ACTION", 0.0, 0.1), ("b", "RETRAIN", 5.0, None), ("c", "NO_ACTION", 0.0, 0.9),
    ], "window_id string, action string, cost double, reliability double")
    got = {r["window_id"]: r["action"] for r in decide.least_invasive(df, 0.8).collect()}
    assert got == {"a": "RECALIBRATE", "b": "HOLD", "c": "NO_ACTION"}


def test_label_sufficiency_counts_absent_classes_as_zero(spark):
    df = spark.createDataFrame([("SAM",)] * 5 + [(None,)], "label string")
    row = decide.label_sufficiency(df, ["Normal", "SAM"], 5, 1).first()
    assert (row["n_labels"], row["n_Normal"], row["min_class_labels"], row["sufficient"]) == (5, 0, 0, False)


REG = "model_id string, seq long, version string, parent string, event string, ts int"


def registry(spark, *events):
    return spark.createDataFrame([("m", i + 1, v, None, e, i) for i, (v, e) in enumerate(events)], REG)


def test_versions_step_and_never_repeat(spark):
    reg = registry(spark, ("1.0", "PROMOTED"), ("1.1", "REJECTED"), ("2.0", "CANDIDATE"), ("2.0", "REJECTED"))
    ask = spark.createDataFrame([("m", "RECALIBRATE"), ("m", "RETRAIN")], "model_id string, action string")
    got = {r["action"]: (r["parent"], r["version"]) for r in adapt.next_version(reg, ask).collect()}
    assert got == {"RECALIBRATE": ("1.0", "1.2"), "RETRAIN": ("1.0", "3.0")}


def test_actions_without_a_version_stay_with_a_reason(spark):
    reg = registry(spark, ("1.0", "CANDIDATE"), ("1.0", "REJECTED"))
    ask = spark.createDataFrame([("m", "RECALIBRATE"), ("m", "RETRAIN"), ("other", "RETRAIN")], "model_id string, action string")
    got = {(r["model_id"], r["action"]): (r["version"], r["reason"]) for r in adapt.next_version(reg, ask).collect()}
    assert got == {("m", "RECALIBRATE"): (None, "no active version"), ("m", "RETRAIN"): ("2.0", None),
                   ("other", "RETRAIN"): (None, "unknown model")}


def test_a_version_promoted_again_can_be_rolled_back_again(spark):
    events = [(1, "1.0", None, "PROMOTED"), (2, "1.1", "1.0", "PROMOTED"), (3, "1.0", "1.1", "ROLLBACK"), (4, "1.1", "1.0", "PROMOTED")]
    reg = spark.createDataFrame([("m", n, v, p, e, n) for n, v, p, e in events], REG)
    back = verify.rollback(reg, 99).first()
    assert (back["seq"], back["version"], back["parent"]) == (5, "1.0", "1.1")


def criteria(spark):
    return spark.createDataFrame([
        ("RECALIBRATE", "ece", "1", "absolute", 0.1), ("RETRAIN", "ece", "1", "absolute", 0.1),
        ("RETRAIN", "recall", "1", "absolute", 0.6), ("RETRAIN", "auroc", "1", "relative", 0.0)], GATE_CRITERIA)


METRIC = "model_id string, action string, metric string, class string, value double"


def test_gate_is_stricter_for_retraining_and_fails_on_missing_metrics(spark):
    rows = [("a", "RECALIBRATE", "ece", "1", 0.05), ("b", "RETRAIN", "ece", "1", 0.05),
            ("c", "RETRAIN", "ece", "1", 0.05), ("c", "RETRAIN", "recall", "1", 0.7), ("c", "RETRAIN", "auroc", "1", 0.8),
            ("d", "RETRAIN", "ece", "1", 0.05), ("d", "RETRAIN", "recall", "1", 0.7), ("d", "RETRAIN", "auroc", "1", 0.79)]
    active = spark.createDataFrame([(m, "auroc", "1", 0.8) for m in "abcd"], "model_id string, metric string, class string, value double")
    got = {r["model_id"]: (r["passed"], r["n_failed"]) for r in verify.gate(spark.createDataFrame(rows, METRIC), active, criteria(spark)).collect()}
    assert got == {"a": (True, 0), "b": (False, 2), "c": (True, 0), "d": (False, 1)}


def test_rejection_leaves_the_active_version(spark):
    reg = registry(spark, ("1.0", "PROMOTED"))
    verdict = lambda ok: spark.createDataFrame([("m", "1.1", "1.0", ok, 50)], "model_id string, version string, parent string, passed boolean, ts int")
    for ok, want in ((True, "1.1"), (False, "1.0"), (None, "1.0")):
        events = reg.unionByName(verify.apply_gate(reg, verdict(ok)))
        assert verify.active_version(events).first()["active_version"] == want
        assert verify.active_version(events, 10).first()["active_version"] == "1.0"


def test_rollback_never_restores_a_withdrawn_version(spark):
    reg = registry(spark, ("1.0", "PROMOTED"), ("1.1", "PROMOTED"), ("1.2", "REJECTED"))
    back = verify.rollback(reg, 99)
    assert [(r["version"], r["parent"], r["seq"]) for r in back.collect()] == [("1.0", "1.1", 4)]
    after = reg.unionByName(back)
    assert verify.active_version(after).first()["active_version"] == "1.0"
    assert verify.rollback(after, 100).count() == 0
    history = [(r["version"], r["valid_from"], r["valid_to"]) for r in verify.version_history(after).orderBy("activation").collect()]
    assert history == [("1.0", 0, 1), ("1.1", 1, 99), ("1.0", 99, None)]


def test_split_isolation(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "record_id string")
    assert verify.assert_disjoint(ids("abb"), ids("cd")).first()["isolated"]
    row = verify.assert_disjoint(ids("abb"), ids("bbc")).first()
    assert (row["n_overlap"], row["isolated"]) == (1, False)


RESULT = "scenario string, strategy string, phase string, metric string, class string, value double"


@pytest.mark.parametrize("metric, original, degraded, after, want", [
    ("macro_f1", 0.80, 0.60, 0.75, 0.75),
    ("ece", 0.02, 0.10, 0.04, 0.75),
    ("macro_f1", 0.80, 0.80, 0.80, None),
    ("macro_f1", 0.80, 0.85, 0.90, None),
    ("ece", 0.10, 0.02, 0.02, None),
])
def test_recovery(spark, metric, original, degraded, after, want):
    rows = [("s", "adaptive", p, metric, "all", v) for p, v in (("original", original), ("degraded", degraded), ("after", after))]
    got = experiment.recovery(spark.createDataFrame(rows, RESULT)).first()["recovery"]
    assert got == (None if want is None else pytest.approx(want))


def test_intervention_rates(spark):
    df = spark.createDataFrame([
        ("x", "RECALIBRATE", "ok"), ("x", "RETRAIN", "degraded"), ("x", "HOLD", "degraded"), ("y", "NO_ACTION", "ok")],
        "strategy string, action string, pre_status string")
    got = {r["strategy"]: r["unnecessary_rate"] for r in experiment.unnecessary_rate(df).collect()}
    assert got == {"x": 0.5, "y": None}
    cost = {r["strategy"]: (r["total_cost"], r["n_holds"]) for r in experiment.maintenance_cost(df, {"RECALIBRATE": 1, "RETRAIN": 4}).collect()}
    assert cost == {"x": (5.0, 1), "y": (0.0, 0)}


def test_rollback_success(spark):
    df = spark.createDataFrame([("x", "REJECTED", 0.5, 0.5), ("x", "ROLLBACK", 0.5, 0.4), ("x", "PROMOTED", 0.5, 0.1)],
                               "strategy string, event string, retained_value double, later_value double")
    row = experiment.rollback_success_rate(df).first()
    assert (row["n_rollbacks"], row["rollback_success_rate"]) == (2, 0.5)


def test_strategies_end_to_end(spark, sf_dir):
    """Closed loop on real rows: the static strategy never moves, rejected candidates change nothing."""
    from steadfold.plans import queries

    rows = queries()["exp1_strategies"](spark, sf_dir).collect()
    value = {(r["scenario"], r["strategy"], r["phase"], r["metric"], r["class"]): r["value"] for r in rows}
    by = {(r["scenario"], r["strategy"]): r for r in rows}
    assert {s for _, s in by} == set(experiment.STRATEGIES)
    for (scenario, strategy, phase, metric, cls), v in value.items():
        if phase == "after" and (strategy == "static" or by[scenario, strategy]["gate"] == "FAIL" or by[scenario, strategy]["action"] in ("NO_ACTION", "HOLD")):
            assert v == value[scenario, strategy, "degraded", metric, cls]
    assert all(r["gate"] in ("PASS", "FAIL") for r in rows if r["strategy"] == "adaptive" and r["action"] in experiment.INTERVENTIONS)


def loop_data(spark, flip=False, n=1500):
    """y follows x; with ``flip`` the outcome rule is reversed."""
    u = lambda s: (F.abs(F.hash(F.col("id"), F.lit(s))) % 10000) / 10000.0
    y = (u(1) + 0.3 * u(2) > 0.65).cast("int")
    return spark.range(n).select(
        F.concat(F.lit("r"), F.col("id")).alias("record_id"), u(1).alias("x"), u(3).alias("z"),
        F.when(F.lit(flip), 1 - y).otherwise(y).cast("string").alias("label"),
        F.when(F.col("id") % 2 == 0, "adapt").otherwise("verify").alias("split"))


@pytest.mark.parametrize("kind, action, promoted, versions", [
    ("same", "NO_ACTION", False, ["1.0"]),
    ("unlabelled", "HOLD", False, ["1.0"]),
    ("flipped", "RETRAIN", True, ["1.0", "2.0"]),
    ("impossible gate", "RETRAIN", False, ["1.0", "2.0"]),
])
def test_maintenance_round(spark, kind, action, promoted, versions):
    from steadfold.operators.loop import maintenance_round
    from steadfold.operators.reliability import metrics_long
    from steadfold.operators.training import score, train

    base = loop_data(spark)
    model = train(base, "logistic", ["x", "z"], classes=["0", "1"])
    baseline = metrics_long(score(base, model, "1.0", ["0", "1"]), ["0", "1"])
    window = loop_data(spark, flip=kind in ("flipped", "impossible gate"))
    if kind == "unlabelled":
        window = window.withColumn("label", F.lit(None).cast("string")).withColumn("x", F.col("x") + 5)
    limit = 1.1 if kind == "impossible gate" else 0.7
    gates = spark.createDataFrame([("RETRAIN", "macro_f1", "all", "absolute", limit)], GATE_CRITERIA)
    reg = registry(spark, ("1.0", "PROMOTED"))
    done = maintenance_round(model, "m", reg, baseline, base, window, ["x", "z"], ["0", "1"], gates, 77, P)
    assert (done.action, done.promoted) == (action, promoted)
    events = done.registry.orderBy("seq").collect()
    assert [e["version"] for e in events] == versions
    want = "2.0" if promoted else "1.0"
    assert verify.active_version(done.registry).first()["active_version"] == want
    if kind == "unlabelled":
        assert done.decision.first()["reason"] == PENDING_WORDING


def test_three_class_boosting_scores(spark):
    from steadfold.operators.training import load_version, save_version, score, train
    from steadfold.session import scratch_path

    df = loop_data(spark, n=300).withColumn("label", F.when(F.col("x") < 0.3, "a").when(F.col("x") < 0.6, "b").otherwise("c"))
    model = train(df, "boosted", ["x", "z"], classes=["a", "b", "c"])
    out = score(df, model, "1.0", ["a", "b", "c"])
    assert out.where("label = predicted").count() > 280
    total = out.select((F.col("probs")["a"] + F.col("probs")["b"] + F.col("probs")["c"]).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    logistic = train(df, "logistic", ["x", "z"], classes=["a", "b", "c"])
    root = scratch_path(spark, "models")
    save_version(logistic, root, "m", "1.0")
    again = score(df, load_version(root, "m", "1.0"), "1.0", ["a", "b", "c"])
    assert again.where("label = predicted").count() == score(df, logistic, "1.0", ["a", "b", "c"]).where("label = predicted").count()
    with pytest.raises(Exception):
        save_version(logistic, root, "m", "1.0")  # a version is written once


def test_weights_reach_boosting(spark):
    from steadfold.operators.training import train

    rows = [(float(i % 10), "a" if i % 3 else "b", 0.01 if i % 3 else 100.0) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, label string, w double")
    predicted = {}
    for weight in (None, "w"):
        model = train(df, "boosted", ["x"], classes=["a", "b"], weight_col=weight)
        predicted[weight] = {r.prediction for r in model.transform(df).select("prediction").distinct().collect()}
    assert predicted == {None: {0.0}, "w": {1.0}}
