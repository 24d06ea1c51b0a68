"""Reliability queries on labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_mille
from ..operators import reliability as m
from ..session import materialize
from .registry import query
from .views import (
    CLASSES, REF_YEAR, SQL_OVR, SQL_QUALITY, SQL_SCORED, quality, r, scored, sql_hash,
)

Y = "snapshot_year"
K = len(CLASSES)
YEAR_CLASSES = 100 * K


@query("rel1_confusion", f"""
WITH {SQL_SCORED} SELECT snapshot_year AS year, label, predicted, COUNT(*) AS n FROM scored GROUP BY ALL""")
def rel1(t):
    return m.confusion(scored(t), [Y]).withColumnRenamed(Y, "year")


SQL_CLASS_METRICS = """
cm AS (SELECT {y}, label, predicted, COUNT(*) AS n FROM {src} WHERE label IS NOT NULL GROUP BY ALL),
cls AS (SELECT {y}, label AS class FROM cm UNION SELECT {y}, predicted FROM cm),
pc AS (SELECT k.{y}, k.class, CAST(COALESCE(SUM(CASE WHEN label = class AND predicted = class THEN n END), 0) AS BIGINT) AS tp,
         CAST(COALESCE(SUM(CASE WHEN label = class THEN n END), 0) AS BIGINT) AS support,
         CAST(COALESCE(SUM(CASE WHEN predicted = class THEN n END), 0) AS BIGINT) AS n_predicted
       FROM cls k JOIN cm ON cm.{y} = k.{y} GROUP BY ALL),
met AS (SELECT *, tp / CAST(nullif(support, 0) AS DOUBLE) AS recall, tp / CAST(nullif(n_predicted, 0) AS DOUBLE) AS precision,
          2 * tp / CAST(nullif(support + n_predicted, 0) AS DOUBLE) AS f1 FROM pc)"""


@query("rel2_class_metrics", f"""
WITH {SQL_SCORED}, {SQL_CLASS_METRICS.format(y=Y, src="scored")}
SELECT snapshot_year AS year, class, tp, support, n_predicted, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(f1, 6) AS f1, round(AVG(f1) OVER (PARTITION BY snapshot_year), 6) AS macro_f1 FROM met""")
def rel2(t):
    return m.class_metrics(scored(t), [Y]).select(
        F.col(Y).alias("year"), "class", "tp", "support", "n_predicted", r("recall"), r("precision"), r("f1"), r("macro_f1"))


SQL_RANK = """
vals AS (SELECT {g}, score, SUM(y) AS pos, SUM(1 - y) AS neg FROM {src} WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
cum AS (SELECT {g}, pos, neg, SUM(neg) OVER up - neg AS below, SUM(pos) OVER down AS tp, SUM(neg) OVER down AS fp,
          SUM(pos) OVER allw AS np, SUM(neg) OVER allw AS nn
        FROM vals WINDOW up AS (PARTITION BY {g} ORDER BY score), down AS (PARTITION BY {g} ORDER BY score DESC), allw AS (PARTITION BY {g})),
rk AS (SELECT {g}, CAST(MAX(np) AS BIGINT) AS n_pos, CAST(MAX(nn) AS BIGINT) AS n_neg,
         SUM(CAST(pos AS DOUBLE) * (below + neg / 2e0)) AS win, SUM(CAST(pos AS DOUBLE) * tp / (tp + fp)) AS ap FROM cum GROUP BY ALL)"""
AUROC = "CASE WHEN n_pos > 0 AND n_neg > 0 THEN win / (CAST(n_pos AS DOUBLE) * n_neg) END"
AUPRC = "CASE WHEN n_pos > 0 AND n_neg > 0 THEN ap / n_pos END"


def ovr(t, keep=(Y,)):
    return m.one_vs_rest(scored(t), CLASSES, keep)


@query("rel3_auroc", f"""
WITH {SQL_OVR}, {SQL_RANK.format(g="snapshot_year, class", src="ovr")}
SELECT snapshot_year AS year, class, n_pos, n_neg, round({AUROC}, 6) AS auroc FROM rk""")
def rel3(t):
    return m.auroc(ovr(t), [Y], group_bound=YEAR_CLASSES).select(
        F.col(Y).alias("year"), "class", "n_pos", "n_neg", r("auroc"))


@query("rel3_auroc_partial_labels", f"""
WITH {SQL_QUALITY}, {SQL_RANK.format(g="lang", src="quality")}
SELECT lang, n_pos, n_neg, round({AUROC}, 6) AS auroc FROM rk""")
def rel3_quality(t):
    one = quality(t).select("lang", F.lit("1").alias("class"), "score", "y")
    return m.auroc(one, ["lang"]).select("lang", "n_pos", "n_neg", r("auroc"))


@query("rel4_auprc", f"""
WITH {SQL_OVR}, {SQL_RANK.format(g="snapshot_year, class", src="ovr")}
SELECT snapshot_year AS year, class, round({AUPRC}, 6) AS auprc FROM rk""")
def rel4(t):
    return m.auprc(ovr(t), [Y], group_bound=YEAR_CLASSES).select(F.col(Y).alias("year"), "class", r("auprc"))


SQL_RELTAB = """
rt AS (SELECT {g}, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, COUNT(*) AS n, AVG(score) AS s, AVG(y) AS o
       FROM {src} WHERE y IS NOT NULL GROUP BY ALL)"""


@query("rel5_reliability_table", f"""
WITH {SQL_OVR}, {SQL_RELTAB.format(g="class", src="ovr")}
SELECT class, bin, n, round(s, 6) AS avg_score, round(o, 6) AS avg_y, round(abs(s - o), 6) AS gap FROM rt""")
def rel5_table(t):
    return m.reliability_table(ovr(t, ())).select("class", "bin", "n", r("avg_score"), r("avg_y"), r("gap"))


@query("rel5_ece", f"""
WITH {SQL_OVR}, {SQL_RELTAB.format(g="snapshot_year, class", src="ovr")}
SELECT snapshot_year AS year, class, CAST(SUM(n) AS BIGINT) AS n, round(SUM(abs(s - o) * n) / SUM(n), 6) AS ece FROM rt GROUP BY ALL""")
def rel5(t):
    return m.ece(ovr(t), by=[Y]).select(F.col(Y).alias("year"), "class", "n", r("ece"))


@query("rel6_brier", f"""
WITH {SQL_SCORED}
SELECT snapshot_year AS year, COUNT(*) AS n, round(AVG(power(pa - CAST(label = 'A' AS INTEGER), 2)
  + power(pn - CAST(label = 'N' AS INTEGER), 2) + power(pr - CAST(label = 'R' AS INTEGER), 2)), 6) AS brier
FROM scored GROUP BY ALL""")
def rel6(t):
    return m.brier(scored(t), CLASSES, [Y]).select(F.col(Y).alias("year"), "n", r("brier"))


# outcomes of the labelled documents become known on day 1 to 60; some are corrected later
def outcomes(t):
    day = F.lit("2024-01-01").cast("date")
    first = t("labels").select(
        F.col("doc_id").alias("record_id"), F.col("quality").cast("string").alias("label"),
        F.date_add(day, (hash_mille("s1", "delay", F.col("doc_id")) % 60).cast("int")).alias("label_ts"))
    again = t("labels").where(hash_mille("s1", "again", F.col("doc_id")) < 200).select(
        F.col("doc_id").alias("record_id"), (1 - F.col("quality")).cast("string").alias("label"),
        F.date_add(day, (61 + hash_mille("s1", "redo", F.col("doc_id")) % 30).cast("int")).alias("label_ts"))
    return first.unionByName(again)


SQL_OUTCOMES = f"""outcomes AS (
  SELECT doc_id AS record_id, CAST(quality AS VARCHAR) AS label,
    CAST(DATE '2024-01-01' + CAST(({sql_hash("'s1|delay|' || doc_id")} % 1000) % 60 AS INTEGER) AS DATE) AS label_ts FROM labels
  UNION ALL SELECT doc_id, CAST(1 - quality AS VARCHAR),
    CAST(DATE '2024-01-01' + CAST(61 + ({sql_hash("'s1|redo|' || doc_id")} % 1000) % 30 AS INTEGER) AS DATE) FROM labels
  WHERE {sql_hash("'s1|again|' || doc_id")} % 1000 < 200)"""
SQL_ATTACHED = """
newest AS (SELECT record_id, max_by(label, label_ts) AS label, MAX(label_ts) AS label_ts FROM outcomes WHERE label_ts <= DATE '{d}' GROUP BY ALL)"""


@query("rel7_attach_labels", f"""
WITH {SQL_OUTCOMES}, {SQL_ATTACHED.format(d="2024-03-10")}
SELECT d.doc_id AS record_id, n.label, n.label_ts FROM documents d LEFT JOIN newest n ON n.record_id = d.doc_id""")
def rel7(t):
    preds = t("documents").select(F.col("doc_id").alias("record_id"))
    return m.attach_labels(preds, outcomes(t), F.lit("2024-03-10").cast("date"))


@query("rel7_label_coverage", f"""
WITH {SQL_OUTCOMES}, {SQL_ATTACHED.format(d="2024-01-31")}
SELECT lang, source, COUNT(*) AS n, COUNT(n.label) AS n_labelled, round(COUNT(n.label) / CAST(COUNT(*) AS DOUBLE), 6) AS coverage
FROM documents d LEFT JOIN newest n ON n.record_id = d.doc_id GROUP BY ALL""")
def rel7_coverage(t):
    preds = t("documents").select(F.col("doc_id").alias("record_id"), "lang", "source")
    known = m.attach_labels(preds, outcomes(t), F.lit("2024-01-31").cast("date"))
    return m.label_coverage(known, ["lang", "source"]).withColumn("coverage", r("coverage"))


@query("rel8_status", f"""
WITH {SQL_QUALITY}, cov AS (SELECT lang, source, COUNT(*) AS n, COUNT(label) / CAST(COUNT(*) AS DOUBLE) AS coverage FROM quality GROUP BY ALL),
b AS (SELECT lang, source, AVG(2 * power(score - y, 2)) AS brier FROM quality WHERE y IS NOT NULL GROUP BY ALL),
s AS (SELECT cov.lang, cov.source, n, coverage, brier,
   CASE WHEN coverage < 0.35e0 OR brier IS NULL THEN 'pending' WHEN brier > 0.4e0 THEN 'degraded' ELSE 'ok' END AS status
   FROM cov LEFT JOIN b ON b.lang = cov.lang AND b.source = cov.source)
SELECT lang, source, n, round(coverage, 6) AS coverage, round(brier, 6) AS brier, status,
  CASE status WHEN 'pending' THEN 'Potential reliability risk detected; outcome-based verification pending.'
    WHEN 'degraded' THEN 'Reliability below the accepted limits.' ELSE 'Reliability within the accepted limits.' END AS message FROM s""")
def rel8(t):
    q = quality(t)
    cov = m.label_coverage(q, ["lang", "source"])
    b = m.brier(q, ["0", "1"], ["lang", "source"]).drop("n")
    return m.reliability_status(cov.join(b, ["lang", "source"], "left"), {"brier": 0.4}, 0.35).select(
        "lang", "source", "n", r("coverage"), r("brier"), "status", "message")


SQL_METRICS_LONG = f"""{SQL_CLASS_METRICS.format(y=Y, src="scored")},
{SQL_RANK.format(g="snapshot_year, class", src="ovr")}, {SQL_RELTAB.format(g="snapshot_year, class", src="ovr")},
ml AS (SELECT snapshot_year, class, 'recall' AS metric, recall AS value FROM met
  UNION ALL SELECT snapshot_year, class, 'precision', precision FROM met UNION ALL SELECT snapshot_year, class, 'f1', f1 FROM met
  UNION ALL SELECT snapshot_year, 'all', 'macro_f1', AVG(f1) FROM met GROUP BY snapshot_year
  UNION ALL SELECT snapshot_year, class, 'auroc', {AUROC} FROM rk UNION ALL SELECT snapshot_year, class, 'auprc', {AUPRC} FROM rk
  UNION ALL SELECT snapshot_year, class, 'ece', SUM(abs(s - o) * n) / SUM(n) FROM rt GROUP BY ALL
  UNION ALL SELECT snapshot_year, 'all', 'brier', AVG(power(pa - CAST(label = 'A' AS INTEGER), 2)
  + power(pn - CAST(label = 'N' AS INTEGER), 2) + power(pr - CAST(label = 'R' AS INTEGER), 2)) FROM scored GROUP BY snapshot_year),
dg AS (SELECT c.snapshot_year, metric, class, c.value, b.value AS base_value,
   (b.value - c.value) * CASE WHEN metric IN ('ece', 'brier') THEN -1 ELSE 1 END AS degradation
   FROM ml c JOIN (SELECT metric, class, value FROM ml WHERE snapshot_year = {REF_YEAR}) b USING (metric, class)
   WHERE c.snapshot_year <> {REF_YEAR})"""


def yearly_degradation(t):
    # the metrics are stored once: the frozen baseline and the current side read the same table
    long = materialize(m.metrics_long(scored(t), CLASSES, by=[Y], group_bound=YEAR_CLASSES), "metrics")
    return m.degradation(long.where(F.col(Y) != REF_YEAR), long.where(F.col(Y) == REF_YEAR))


@query("rel9_degradation", f"""
WITH {SQL_OVR}, {SQL_METRICS_LONG}
SELECT snapshot_year AS year, metric, class, round(value, 6) AS value, round(base_value, 6) AS base_value,
  round(degradation, 5) + 0e0 AS degradation FROM dg""")
def rel9(t):
    return yearly_degradation(t).select(
        F.col(Y).alias("year"), "metric", "class", r("value"), r("base_value"), r("degradation", 5))


@query("rel10_shift_impact", f"""
WITH {SQL_OVR}, {SQL_METRICS_LONG}, sh AS (SELECT snapshot_year, abs(AVG(l_quantity) - (SELECT AVG(l_quantity) FROM cohorts WHERE snapshot_year = {REF_YEAR})) AS shift
  FROM cohorts GROUP BY ALL)
SELECT metric, class, COUNT(*) AS n, round(corr(degradation, shift), 5) AS corr, round(regr_slope(degradation, shift), 5) AS slope
FROM dg JOIN sh USING (snapshot_year) GROUP BY ALL""")
def rel10(t):
    from .views import cohorts
    means = cohorts(t).groupBy(Y).agg(F.avg("l_quantity").alias("m"))
    ref = means.where(F.col(Y) == REF_YEAR).select(F.col("m").alias("ref"), F.lit(1).alias("one"))
    shift = means.withColumn("one", F.lit(1)).join(F.broadcast(ref), "one").select(Y, F.abs(F.col("m") - F.col("ref")).alias("shift"))
    return m.shift_impact(yearly_degradation(t).join(shift, Y), ["metric", "class"]).select(
        "metric", "class", "n", r("corr", 5), r("slope", 5))
