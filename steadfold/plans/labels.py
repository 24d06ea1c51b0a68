"""Indicator, label and feature-preparation queries; model training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import labels as m
from ..operators import model_tables, training
from ..operators.ingest import assign_split
from ..operators.reliability import class_metrics, metrics_long, ranking_metrics
from ..session import join_bounded, materialize
from .registry import query
from .reliability import AUROC, SQL_RANK
from .shift import SQL_STRESSED, stressed
from .views import SHAPE, SQL_COHORTS, SQL_SHAPES, cohorts, quality, r, shapes, sql_hash, sql_long

Y = "snapshot_year"
SPLITS = {"reference": 600, "adapt": 200, "verify": 200}


def indicators(t):
    """Three overlapping indicators (with gaps) and a recorded category."""
    return stressed(t).select(
        "record_id", Y,
        (F.col("l_discount") > 0.05).alias("stunted"),
        (F.col("l_tax") > 0.04).alias("wasted"),
        (F.col("l_quantity") < 10).alias("underweight"),
        F.when(F.col("l_returnflag") == "N", "Normal").when(F.col("l_returnflag") == "A", "MAM").otherwise("SAM").alias("category"),
    )


SQL_INDICATORS = SQL_STRESSED + """,
ind AS (SELECT record_id, snapshot_year, l_discount > 0.05e0 AS stunted, l_tax > 0.04e0 AS wasted, l_quantity < 10 AS underweight,
  CASE l_returnflag WHEN 'N' THEN 'Normal' WHEN 'A' THEN 'MAM' ELSE 'SAM' END AS category FROM stressed)"""


@query("lab1_indicator_overlap", f"""
WITH {SQL_INDICATORS}
SELECT stunted, wasted, underweight, CAST(GROUPING(stunted, wasted, underweight) AS INTEGER) AS level, COUNT(*) AS n
FROM ind GROUP BY CUBE (stunted, wasted, underweight)""")
def lab1(t):
    return m.indicator_overlap(indicators(t))


@query("lab2_label_crosstab", f"""
WITH {SQL_INDICATORS}
SELECT stunted, wasted, underweight, {", ".join(f"CAST(SUM(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{c}" for c in m.CATEGORIES)},
  COUNT(*) AS n, CAST(SUM(CASE WHEN (COALESCE(stunted, false) OR COALESCE(wasted, false) OR COALESCE(underweight, false))
    AND category = 'Normal' THEN 1 ELSE 0 END) AS BIGINT) AS n_abnormal_not_case
FROM ind GROUP BY ALL""")
def lab2(t):
    return m.label_crosstab(indicators(t))


@query("lab3_class_balance", f"""
WITH {SQL_INDICATORS}, c AS (SELECT snapshot_year, category AS class, COUNT(*) AS n FROM ind GROUP BY ALL)
SELECT snapshot_year, class, n, round(n / CAST(SUM(n) OVER (PARTITION BY snapshot_year) AS DOUBLE), 6) AS share,
  CAST(row_number() OVER (PARTITION BY snapshot_year ORDER BY n, class) AS INTEGER) AS rarity FROM c""")
def lab3(t):
    return m.class_balance(indicators(t)).withColumn("share", r("share"))


ROLES = {"record_id": "id", "snapshot_year": "id", "l_quantity": "anthropometric", "l_extendedprice": "anthropometric",
         "l_linestatus": "outcome", "l_discount": "upstream", "l_tax": "upstream"}


@query("lab4_upstream_projection", f"""
WITH {SQL_COHORTS} SELECT record_id, snapshot_year, l_discount, l_tax, l_returnflag FROM cohorts""")
def lab4(t):
    return m.select_upstream(cohorts(t), ROLES, target="l_returnflag")


@query("lab5_leakage_report", f"""
WITH {SQL_SHAPES}, lab AS (SELECT s.*, quality AS y FROM shapes s JOIN labels l ON l.doc_id = s.record_id),
long AS (SELECT feature, value AS score, y FROM ({sql_long("lab", SHAPE, "y")})), {SQL_RANK.format(g="feature", src="long")},
a AS (SELECT feature, n_pos, n_neg, {AUROC} AS auroc FROM rk)
SELECT feature, n_pos, n_neg, round(auroc, 6) AS auroc, round(greatest(auroc, 1 - auroc), 6) AS separability,
  greatest(auroc, 1 - auroc) > 0.8e0 AS suspect FROM a""")
def lab5(t):
    lab = shapes(t).join(t("labels").select(F.col("doc_id").alias("record_id"), "quality"), "record_id")
    return m.leakage_report(lab, "quality", SHAPE, 0.8).select(
        "feature", "n_pos", "n_neg", r("auroc"), r("separability"), "suspect")


@query("lab6_impute", f"""
WITH {SQL_STRESSED}, s AS (SELECT *, {sql_hash("'frozen|' || record_id")} % 1000 AS h FROM stressed),
st AS (SELECT AVG(l_quantity) AS mq, AVG(l_tax) AS mt FROM s WHERE h < 600)
SELECT snapshot_year, COUNT(*) AS n, CAST(SUM(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_quantity_missing,
  CAST(SUM(CASE WHEN l_tax IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_tax_missing,
  round(AVG(COALESCE(l_quantity, mq)), 6) AS mean_quantity, round(AVG(COALESCE(l_tax, mt)), 6) AS mean_tax
FROM s, st GROUP BY ALL""")
def lab6(t):
    data = assign_split(stressed(t), "record_id", SPLITS, "frozen")
    stats = m.fit_impute(data.where("split = 'reference'"), ["l_quantity", "l_tax"])
    return m.impute(data, stats).groupBy(Y).agg(
        F.count("*").alias("n"), F.sum("l_quantity_missing").alias("n_quantity_missing"), F.sum("l_tax_missing").alias("n_tax_missing"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


MODEL_FEATURES = ["word_ratio", "size_log"]


def text_data(t):
    """Labelled documents with a frozen split, features for a trainable model."""
    return assign_split(quality(t).where("label is not null"), "record_id", SPLITS, "frozen").select(
        "record_id", "lang", "source", "label", "split", *SHAPE)


@query("lab7_train_families")
def lab7(t):
    data = materialize(text_data(t), "text")
    parts = []
    for family in training.FAMILIES:
        model = training.train(data.where("split = 'reference'"), family, MODEL_FEATURES, classes=["0", "1"])
        scored = training.score(data.where("split = 'verify'"), model, "1.0", ["0", "1"]).withColumn("family", F.lit(family))
        parts.append(scored)
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return metrics_long(every, ["0", "1"], by=["family"], group_bound=6).withColumn("value", r("value"))


@query("lab8_select_family", f"""
WITH {SQL_SHAPES}, lab AS (SELECT s.*, quality AS y FROM shapes s JOIN labels l ON l.doc_id = s.record_id
  WHERE {sql_hash("'frozen|' || s.record_id")} % 1000 >= 800),
long AS (SELECT lang, feature AS family, value AS score, y FROM ({sql_long("lab", SHAPE, "lang, y")})), {SQL_RANK.format(g="lang, family", src="long")},
a AS (SELECT lang, family, {AUROC} AS value FROM rk)
SELECT lang, family, 'auroc' AS metric, round(value, 6) AS value FROM
 (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY value DESC NULLS LAST, family) AS rn FROM a) WHERE rn = 1""")
def lab8(t):
    held = text_data(t).where("split = 'verify'")
    scores = held.unpivot(["lang", "label"], SHAPE, "family", "score").select(
        "lang", "family", F.lit("1").alias("class"), "score", F.col("label").cast("int").alias("y"))
    results = ranking_metrics(scores, ["lang", "family"]).select(
        "lang", "family", F.lit("auroc").alias("metric"), F.round("auroc", 6).alias("value"))
    return m.select_family(results, "auroc", by=["lang"])


@query("lab9_batch_score")
def lab9(t):
    data = text_data(t)
    model = training.train(data.where("split = 'reference'"), "logistic", MODEL_FEATURES, classes=["0", "1"])
    every = quality(t).select("record_id", "label", *MODEL_FEATURES)
    return training.score(every, model, "1.0", ["0", "1"]).select(
        "record_id", "model_version", "predicted", F.round(F.col("probs")["1"], 6).alias("p1"))


@query("lab9_table_scores", f"""
WITH {SQL_SHAPES}, lab AS (SELECT {sql_hash("'frozen|' || s.record_id")} % 1000 AS h FROM shapes s JOIN labels l ON l.doc_id = s.record_id WHERE quality IS NOT NULL),
c AS (SELECT COUNT(*) FILTER (h < {SPLITS["reference"]}) AS n_fit, COUNT(*) AS n_scored FROM lab)
SELECT class, feature, n_fit, n_scored, TRUE AS at_optimum, TRUE AS scores_agree
FROM c, (SELECT unnest(['0', '1']) AS class), (SELECT unnest(['{model_tables.INTERCEPT}', {", ".join(f"'{f}'" for f in MODEL_FEATURES)}]) AS feature)""")
def lab9_table(t):
    """The fitted model as a table: every labelled row scored by it as by the model, and the fit is an optimum."""
    data, classes = materialize(text_data(t), "text"), ["0", "1"]
    model = training.train(data.where("split = 'reference'"), "logistic", MODEL_FEATURES, classes=classes)
    own = training.score(data, model, "1.0", classes, keep=["record_id", "label", "split", *MODEL_FEATURES]).withColumnRenamed("probs", "model_probs")
    table = model_tables.logistic_table(t.spark, model, "1.0", MODEL_FEATURES, classes)
    scored = materialize(model_tables.score_by_table(own, table, MODEL_FEATURES, n_versions=1), "scored")
    apart = F.max(F.coalesce(F.abs(F.col("probs")["1"] - F.col("model_probs")["1"]), F.lit(1.0)))  # a missing score agrees with nothing
    seen = scored.agg(F.count("*").alias("n_scored"), (apart < 1e-9).alias("scores_agree")).withColumn("model_version", F.lit("1.0"))
    at = model_tables.gradient(scored.where("split = 'reference'"), MODEL_FEATURES).withColumn("model_version", F.lit("1.0"))
    return join_bounded(at, seen, ["model_version"], rows=1).select(
        "class", "feature", F.col("n").alias("n_fit"), "n_scored", (F.abs("gradient") < 1e-3).alias("at_optimum"), "scores_agree")


@query("lab7_three_class_model")
def lab7_three(t):
    data = cohorts(t).withColumnRenamed("l_returnflag", "label")
    features = ["l_discount", "l_tax", "l_quantity"]
    ref = data.where("snapshot_year < 2000")
    model = training.train(ref, "logistic", features, classes=["A", "N", "R"])
    scored = training.score(data.where("snapshot_year >= 2000"), model, "1.0", ["A", "N", "R"])
    return class_metrics(scored).select("class", "support", r("recall"), r("precision"), r("f1"), r("macro_f1"))
