"""Strategy comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiment as m
from ..operators import training
from ..operators.decide import DecisionPolicy
from ..operators.labels import fit_impute
from ..operators.loop import maintenance_round
from ..operators.reliability import metrics_long
from ..operators.scenarios import Scenario, apply_scenario
from ..session import literal_table, materialize
from .labels import MODEL_FEATURES, text_data
from .registry import query
from .views import r

SCENARIOS = [
    Scenario("gaps", "data quality", "missing", ["word_ratio"], {"rate": 0.1}),
    Scenario("mix", "covariate", "composition", params={"stratum": "lang", "keep": {"en": 0.2}}),
    Scenario("surge", "prevalence", "prevalence", params={"label": "label", "copies": {"0": 3.0}}),
    Scenario("flip", "concept", "concept", params={
        "label": "label", "remap": {"1": "0"}, "region": "word_ratio > 0.7"}, tier="stretch"),
]
CRITERIA = [
    ("RECALIBRATE", "ece", "1", "relative", 0.0), ("RECALIBRATE", "macro_f1", "all", "relative", 0.02),
    ("RETRAIN", "macro_f1", "all", "relative", 0.0), ("RETRAIN", "recall", "0", "absolute", 0.3),
    ("RETRAIN", "brier", "all", "relative", 0.02),
]
POLICY = DecisionPolicy(max_bad_rate=0.5, shift_limit=0.05, min_labels_recalibrate=20, min_labels_retrain=30,
                        min_class_labels_retrain=5)


@query("exp1_strategies")
def exp1(t):
    data = text_data(t).select("record_id", "lang", "label", "split", *MODEL_FEATURES)
    fill = fit_impute(data.where("split = 'reference'"), MODEL_FEATURES)
    criteria = literal_table(t.spark, CRITERIA, "action string, metric string, class string, kind string, limit double")
    return m.run_strategies(data, SCENARIOS, MODEL_FEATURES, ["0", "1"], criteria, fill, POLICY).withColumn("value", r("value"))


# results and actions derived from orders: priority is the scenario, status the phase
STRATEGY = ["static", "always_recalibrate", "always_retrain", "adaptive"]


def _strategy(n):
    out = F.lit(STRATEGY[3])
    for i in (2, 1, 0):
        out = F.when(n % 4 == i, STRATEGY[i]).otherwise(out)
    return out


SQL_STRATEGY = "CASE {n} % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'always_recalibrate' WHEN 2 THEN 'always_retrain' ELSE 'adaptive' END"


def results(t):
    phase = F.when(F.col("o_orderstatus") == "O", "original").when(F.col("o_orderstatus") == "F", "degraded").otherwise("after")
    return t("orders").groupBy(
        F.col("o_orderpriority").alias("scenario"), _strategy(F.col("o_custkey")).alias("strategy"), phase.alias("phase"),
        F.when(F.col("o_orderkey") % 2 == 0, "ece").otherwise("macro_f1").alias("metric"), F.lit("all").alias("class"),
    ).agg(F.round(F.avg("o_totalprice") / 500000, 8).alias("value"))


SQL_RESULTS = f"""results AS (SELECT o_orderpriority AS scenario, {SQL_STRATEGY.format(n="o_custkey")} AS strategy,
  CASE o_orderstatus WHEN 'O' THEN 'original' WHEN 'F' THEN 'degraded' ELSE 'after' END AS phase,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ece' ELSE 'macro_f1' END AS metric, 'all' AS class, round(AVG(o_totalprice) / 500000, 8) AS value
  FROM orders GROUP BY ALL),
wide AS (SELECT scenario, strategy, metric, class, MAX(CASE WHEN phase = 'original' THEN value END) AS original,
  MAX(CASE WHEN phase = 'degraded' THEN value END) AS degraded, MAX(CASE WHEN phase = 'after' THEN value END) AS after FROM results GROUP BY ALL),
rec AS (SELECT *, CASE WHEN (original - degraded) * CASE WHEN metric = 'ece' THEN -1 ELSE 1 END > 1e-9
  THEN (after - degraded) / (original - degraded) END AS recovery FROM wide)"""


@query("exp2_recovery", f"""
WITH {SQL_RESULTS} SELECT scenario, strategy, metric, class, original, degraded, after, round(recovery, 4) AS recovery FROM rec""")
def exp2(t):
    return m.recovery(results(t)).withColumn("recovery", r("recovery", 4))


def actions(t):
    """What each strategy did per (scenario, year, area), decided by the order counts."""
    counted = t("orders").groupBy(
        F.col("o_orderpriority").alias("scenario"), _strategy(F.col("o_custkey")).alias("strategy"),
        F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("v"))
    k = F.col("n") % 4
    return counted.select(
        "scenario", "strategy", "year", "n",
        F.when(k == 0, "NO_ACTION").when(k == 1, "RECALIBRATE").when(k == 2, "RETRAIN").otherwise("HOLD").alias("action"),
        F.when(F.col("n") % 3 == 0, "ok").otherwise("degraded").alias("pre_status"),
        (F.col("n") % 5 != 0).alias("passed"),
        F.when(F.col("n") % 2 == 0, "REJECTED").when(F.col("n") % 7 == 0, "ROLLBACK").otherwise("PROMOTED").alias("event"),
        F.round(F.col("v"), 4).alias("retained_value"),
        F.round(F.col("v") + F.when(F.col("n") % 6 == 0, 1.0).otherwise(0.0), 4).alias("later_value"))


SQL_ACTIONS = f"""counted AS (SELECT o_orderpriority AS scenario, {SQL_STRATEGY.format(n="o_custkey")} AS strategy, year(o_orderdate) AS year,
  COUNT(*) AS n, AVG(o_totalprice) AS v FROM orders GROUP BY ALL),
act AS (SELECT *, CASE n % 4 WHEN 0 THEN 'NO_ACTION' WHEN 1 THEN 'RECALIBRATE' WHEN 2 THEN 'RETRAIN' ELSE 'HOLD' END AS action,
  n % 3 = 0 AS was_ok, n % 5 <> 0 AS passed, CASE WHEN n % 2 = 0 THEN 'REJECTED' WHEN n % 7 = 0 THEN 'ROLLBACK' ELSE 'PROMOTED' END AS event FROM counted)"""
ACTED = "action IN ('RECALIBRATE', 'RETRAIN')"


@query("exp3_unnecessary_rate", f"""
WITH {SQL_ACTIONS}, s AS (SELECT strategy, CAST(SUM(CASE WHEN {ACTED} THEN 1 ELSE 0 END) AS BIGINT) AS n_interventions,
  CAST(SUM(CASE WHEN {ACTED} AND was_ok THEN 1 ELSE 0 END) AS BIGINT) AS n_unnecessary FROM act GROUP BY ALL)
SELECT *, round(n_unnecessary / CAST(nullif(n_interventions, 0) AS DOUBLE), 6) AS unnecessary_rate FROM s""")
def exp3(t):
    return m.unnecessary_rate(actions(t)).withColumn("unnecessary_rate", r("unnecessary_rate"))


@query("exp4_failed_adaptation", f"""
WITH {SQL_ACTIONS}, s AS (SELECT strategy, COUNT(*) AS n_candidates, CAST(SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS n_failed
  FROM act WHERE {ACTED} GROUP BY ALL)
SELECT *, round(n_failed / CAST(n_candidates AS DOUBLE), 6) AS failed_rate FROM s""")
def exp4(t):
    tried = actions(t).where(F.col("action").isin(*m.INTERVENTIONS))
    return m.failed_adaptation_rate(tried).withColumn("failed_rate", r("failed_rate"))


@query("exp5_rollback_success", f"""
WITH {SQL_ACTIONS}, s AS (SELECT strategy, COUNT(*) AS n_rollbacks, CAST(SUM(CASE WHEN n % 6 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_restored
  FROM act WHERE event <> 'PROMOTED' GROUP BY ALL)
SELECT *, round(n_restored / CAST(n_rollbacks AS DOUBLE), 6) AS rollback_success_rate FROM s""")
def exp5(t):
    return m.rollback_success_rate(actions(t)).withColumn("rollback_success_rate", r("rollback_success_rate"))


@query("exp6_cost", f"""
WITH {SQL_ACTIONS}, s AS (SELECT strategy, COUNT(*) AS n_windows, CAST(SUM(CASE WHEN {ACTED} THEN 1 ELSE 0 END) AS BIGINT) AS n_interventions,
  CAST(SUM(CASE WHEN action = 'HOLD' THEN 1 ELSE 0 END) AS BIGINT) AS n_holds,
  SUM(CASE action WHEN 'RECALIBRATE' THEN 1e0 WHEN 'RETRAIN' THEN 5e0 WHEN 'HOLD' THEN 0.5e0 ELSE 0e0 END) AS total_cost FROM act GROUP BY ALL)
SELECT *, round(n_interventions / CAST(n_windows AS DOUBLE), 6) AS frequency FROM s""")
def exp6(t):
    return m.maintenance_cost(actions(t), {"RECALIBRATE": 1.0, "RETRAIN": 5.0, "HOLD": 0.5}).withColumn("frequency", r("frequency"))


@query("exp7_recovery_by_strategy", f"""
WITH {SQL_RESULTS} SELECT scenario, class, {", ".join(f"round(AVG(CASE WHEN strategy = '{s}' THEN recovery END), 4) AS {s}" for s in STRATEGY)}
FROM rec WHERE metric = 'macro_f1' GROUP BY ALL""")
def exp7_table(t):
    table, _ = m.strategy_comparison(m.recovery(results(t)), actions(t), "macro_f1")
    return table.select("scenario", "class", *[r(s, 4) for s in STRATEGY])


@query("exp7_ranking", f"""
WITH {SQL_RESULTS}, {SQL_ACTIONS}, a AS (SELECT strategy, CAST(SUM(CASE WHEN {ACTED} THEN 1 ELSE 0 END) AS BIGINT) AS n_interventions FROM act GROUP BY ALL),
x AS (SELECT strategy, AVG(recovery) AS mean_recovery FROM rec WHERE metric = 'macro_f1' GROUP BY ALL)
SELECT strategy, round(mean_recovery, 4) AS mean_recovery, n_interventions, CAST(rank() OVER (ORDER BY mean_recovery DESC NULLS LAST) AS INTEGER) AS recovery_rank,
  CAST(rank() OVER (ORDER BY n_interventions) AS INTEGER) AS intervention_rank FROM x JOIN a USING (strategy)""")
def exp7_ranking(t):
    _, ranking = m.strategy_comparison(m.recovery(results(t)), actions(t), "macro_f1")
    return ranking.withColumn("mean_recovery", r("mean_recovery", 4))


@query("loop_maintenance_round")
def loop_round(t):
    """One closed loop on the labelled documents after a change of the outcome rule."""
    data = text_data(t).select("record_id", "lang", "label", "split", *MODEL_FEATURES)
    reference = data.where("split = 'reference'")
    model = training.train(reference, "logistic", MODEL_FEATURES, classes=["0", "1"])
    held = training.score(data.where("split = 'verify'"), model, "1.0", ["0", "1"])
    baseline = materialize(metrics_long(held, ["0", "1"]), "baseline")
    window = apply_scenario(data.where("split <> 'reference'"), SCENARIOS[-1], "record_id")
    registry = literal_table(t.spark, [("m", 1, "1.0", None, "PROMOTED", "2024-01-01")],
                             "model_id string, seq bigint, version string, parent string, event string, ts date")
    criteria = literal_table(t.spark, CRITERIA, "action string, metric string, class string, kind string, limit double")
    done = maintenance_round(model, "m", registry, baseline, reference, window, MODEL_FEATURES, ["0", "1"], criteria,
                             F.lit("2024-06-01").cast("date"), POLICY)
    return done.registry.withColumns({"action": F.lit(done.action), "promoted": F.lit(done.promoted)})
