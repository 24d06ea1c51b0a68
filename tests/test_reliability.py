from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from steadfold.operators import adapt, reliability as rel


def binary(spark, rows):
    return spark.createDataFrame([("1", float(s), y) for s, y in rows], "class string, score double, y int")


def scored(spark, rows):
    """rows of (label, {class: p})"""
    data = [(str(i), y, p, max(sorted(p), key=lambda c: p[c])) for i, (y, p) in enumerate(rows)]
    return spark.createDataFrame(data, "record_id string, label string, probs map<string,double>, predicted string")


@pytest.mark.parametrize("rows, want", [
    ([(0.5, 1), (0.5, 0), (0.5, 0)], 0.5),
    ([(0.9, 1), (0.8, 1), (0.1, 0)], 1.0),
    ([(0.1, 1), (0.2, 1), (0.9, 0)], 0.0),
    ([(0.1, 0), (0.2, 0)], None),
    ([(0.1, 1)], None),
])
def test_auroc_edge_cases(spark, rows, want):
    assert rel.auroc(binary(spark, rows)).first()["auroc"] == want


def test_auroc_and_auprc_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(300)]
    got = rel.ranking_metrics(binary(spark, rows), n_buckets=4).first()
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["auroc"] == pytest.approx(wins / (len(pos) * len(neg)))
    ap, before = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    assert got["auprc"] == pytest.approx(ap)


def test_auroc_ignores_monotone_rescaling_and_partitioning(spark):
    rng = random.Random(2)
    df = binary(spark, [(rng.random(), int(rng.random() < 0.4)) for _ in range(200)])
    a = rel.auroc(df).first()["auroc"]
    b = rel.auroc(df.withColumn("score", F.pow("score", F.lit(3))).repartition(7)).first()["auroc"]
    assert 0 <= a <= 1 and a == b


def test_constant_prevalence_is_calibrated(spark):
    rows = [("1" if i < 30 else "0", {"0": 0.7, "1": 0.3}) for i in range(100)]
    df = scored(spark, rows)
    e = {r["class"]: r["ece"] for r in rel.ece(rel.one_vs_rest(df, ["0", "1"])).collect()}
    assert e == pytest.approx({"0": 0, "1": 0})
    # summed over both classes: twice p(1 - p)
    assert rel.brier(df, ["0", "1"]).first()["brier"] == pytest.approx(2 * 0.3 * 0.7)


def test_class_metrics_with_a_class_that_is_never_predicted(spark):
    df = scored(spark, [("a", {"a": 0.9, "b": 0.1}), ("b", {"a": 0.8, "b": 0.2}), (None, {"a": 0.1, "b": 0.9})])
    got = {r["class"]: r for r in rel.class_metrics(df).collect()}
    assert got["a"]["recall"] == 1 and got["a"]["precision"] == 0.5
    assert set(got) == {"a", "b"}  # the unlabelled row takes no part
    assert got["b"]["recall"] == 0 and got["b"]["precision"] is None and got["b"]["f1"] == 0
    assert got["a"]["macro_f1"] == pytest.approx((2 / 3) / 2)


def test_metrics_long_agrees_with_the_single_metrics(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        p = rng.random()
        rows.append(("1" if rng.random() < p else "0", {"0": 1 - p, "1": p}))
    df = scored(spark, rows)
    got = {(r["metric"], r["class"]): r["value"] for r in rel.metrics_long(df, ["0", "1"]).collect()}
    ovr = rel.one_vs_rest(df, ["0", "1"])
    for r in rel.ranking_metrics(ovr).collect():
        assert got["auroc", r["class"]] == pytest.approx(r["auroc"])
        assert got["auprc", r["class"]] == pytest.approx(r["auprc"])
    for r in rel.ece(ovr).collect():
        assert got["ece", r["class"]] == pytest.approx(r["ece"])
    assert got["brier", "all"] == pytest.approx(rel.brier(df, ["0", "1"]).first()["brier"])


def test_labels_after_the_cut_are_invisible_and_corrections_win(spark):
    preds = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
    outcomes = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 9)], "record_id string, label string, label_ts int")
    at = lambda ts: {r["record_id"]: r["label"] for r in rel.attach_labels(preds, outcomes, ts).collect()}
    assert at(2) == {"a": "x", "b": None, "c": None}
    assert at(9) == {"a": "y", "b": "x", "c": None}


def test_status_wording(spark):
    df = spark.createDataFrame([(0.0, None, True), (0.9, 0.1, True), (0.9, 0.9, True), (0.0, None, False)],
                               "coverage double, brier double, shift_detected boolean")
    got = [(r["status"], r["message"]) for r in rel.reliability_status(df, {"brier": 0.5}, 0.5).collect()]
    assert [s for s, _ in got] == ["pending", "ok", "degraded", "pending"]
    assert got[0][1] == "Potential reliability risk detected; outcome-based verification pending."
    assert "failing" not in " ".join(m for _, m in got)


def test_degradation_is_positive_when_worse(spark):
    base = spark.createDataFrame([("auroc", "1", 0.8), ("ece", "1", 0.02)], "metric string, class string, value double")
    cur = spark.createDataFrame([("auroc", "1", 0.6), ("ece", "1", 0.10)], "metric string, class string, value double")
    got = {r["metric"]: r["degradation"] for r in rel.degradation(cur, base).collect()}
    assert got == pytest.approx({"auroc": 0.2, "ece": 0.08})


def test_temperature_keeps_the_predicted_class_and_flags_the_edge(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), {"a": p, "b": 1 - p}) for p in (rng.uniform(0.01, 0.99) for _ in range(200))]
    df = scored(spark, rows)
    fit = adapt.fit_temperature(df, ["a", "b"], [0.5, 1.0, 2.0]).first()
    assert fit["temperature"] == 2.0 and fit["on_edge"]  # labels are noise: flatter is always better
    top = F.when(F.col("probs")["a"] >= F.col("probs")["b"], "a").otherwise("b")
    moved = adapt.apply_temperature(df, ["a", "b"], 3.0).where(top != F.col("predicted"))
    assert moved.count() == 0
    wide = adapt.fit_temperature(df, ["a", "b"], adapt.temperature_grid(0.01, 100, 41)).first()
    assert wide["nll"] <= fit["nll"]


def test_isotonic_is_monotone_and_pools_violators(spark):
    rows = [(0.05, 0)] * 5 + [(0.35, 1)] * 5 + [(0.55, 0)] * 5 + [(0.95, 1)] * 5
    model, table = adapt.fit_isotonic(binary(spark, rows), 10)
    got = [(r["bin"], r["calibrated"]) for r in table.orderBy("bin").collect()]
    assert got == [(0, 0.0), (3, 0.5), (5, 0.5), (9, 1.0)]
    out = adapt.apply_isotonic(binary(spark, [(0.45, 0)]), model).first()
    assert out["calibrated"] == pytest.approx(0.5)


def test_platt_recovers_a_known_distortion(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(4000):
        z = rng.uniform(-3, 3)
        p = 1 / (1 + 2.718281828 ** -z)
        rows.append((1 / (1 + 2.718281828 ** (-2 * z)), int(rng.random() < p)))
    a, b = adapt.fit_platt(binary(spark, rows))
    assert a == pytest.approx(0.5, abs=0.08) and b == pytest.approx(0, abs=0.12)


def test_reweight_reaches_the_current_shares(spark):
    ref = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10 + [("c",)] * 10, "s string")
    cur = spark.createDataFrame([("a",)] * 5 + [("b",)] * 15, "s string")
    got = {r["s"]: r["w"] for r in adapt.reweight(ref, cur, ["s"]).groupBy("s").agg(F.sum("weight").alias("w")).collect()}
    assert got == pytest.approx({"a": 12.5, "b": 37.5, "c": 0})
