"""Decide, adapt, verify and promote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adapt, decide, training, verify
from ..operators.ingest import assign_split
from ..operators.reliability import PENDING_WORDING, brier, ece, metrics_long, one_vs_rest
from ..session import literal_table
from .labels import MODEL_FEATURES, text_data
from .registry import query
from .reliability import SQL_RELTAB
from .views import CLASSES, SQL_COHORTS, SQL_OVR, SQL_QUALITY, SQL_SCORED, cohorts, quality, r, scored, sql_hash

Y = "snapshot_year"
WINDOW = ["lang", "source"]

# ------------------------------------------------------------------ decide


def evidence(t):
    """One evidence row per (lang, source) window of the documents."""
    wrong = (F.col("predicted") != F.col("label")).cast("int")
    return quality(t).groupBy(*WINDOW).agg(
        F.round(F.avg((F.col("size_log") < 5.5).cast("int")), 6).alias("bad_rate"),
        F.round(F.abs(F.avg("word_ratio") - 0.7), 6).alias("shift"),
        F.count("label").alias("n_labels"),
        F.least(F.sum("y"), F.sum(1 - F.col("y"))).alias("min_class_labels"),
        F.round(F.avg(wrong) - 0.3, 6).alias("perf_loss"),
        F.round(F.abs(F.avg(F.when(F.col("y").isNotNull(), F.col("score"))) - F.avg("y")) - 0.1, 6).alias("calibration_loss"),
    )


SQL_EVIDENCE = SQL_QUALITY + """,
ev AS (SELECT lang, source, round(AVG(CAST(size_log < 5.5e0 AS INTEGER)), 6) AS bad_rate, round(abs(AVG(word_ratio) - 0.7e0), 6) AS shift,
  COUNT(label) AS n_labels, CAST(least(SUM(y), SUM(1 - y)) AS BIGINT) AS min_class_labels,
  round(AVG(CASE WHEN label IS NULL THEN NULL WHEN (CASE WHEN score >= 0.5e0 THEN '1' ELSE '0' END) <> label THEN 1 ELSE 0 END) - 0.3e0, 6) AS perf_loss,
  round(abs(AVG(CASE WHEN y IS NOT NULL THEN score END) - AVG(y)) - 0.1e0, 6) AS calibration_loss
  FROM quality GROUP BY ALL)"""

POLICY = decide.DecisionPolicy(
    max_bad_rate=0.35, shift_limit=0.02, perf_ok=0.0, perf_degraded=0.08, calibration_ok=0.02,
    calibration_degraded=0.06, min_labels_recalibrate=8, min_labels_retrain=12, min_class_labels_retrain=4)


@query("dec1_decision_table", f"""
WITH {SQL_EVIDENCE},
rl AS (SELECT *, CASE WHEN bad_rate > 0.35e0 THEN 1
  WHEN (n_labels = 0 OR perf_loss IS NULL OR calibration_loss IS NULL) AND shift > 0.02e0 THEN 2
  WHEN n_labels = 0 OR perf_loss IS NULL OR calibration_loss IS NULL THEN 3
  WHEN perf_loss <= 0e0 AND calibration_loss <= 0.02e0 THEN 4
  WHEN perf_loss <= 0e0 AND calibration_loss > 0.06e0 AND n_labels >= 8 THEN 5
  WHEN perf_loss > 0.08e0 AND n_labels >= 12 AND min_class_labels >= 4 THEN 6
  WHEN perf_loss > 0.08e0 OR (perf_loss <= 0e0 AND calibration_loss > 0.06e0) THEN 7 ELSE 8 END AS rule FROM ev)
SELECT lang, source, rule, CASE WHEN rule IN (3, 4) THEN 'NO_ACTION' WHEN rule = 5 THEN 'RECALIBRATE' WHEN rule = 6 THEN 'RETRAIN' ELSE 'HOLD' END AS action,
  CASE rule WHEN 1 THEN 'data quality severely compromised' WHEN 2 THEN '{PENDING_WORDING}' WHEN 3 THEN 'no shift; reliability unverified'
    WHEN 4 THEN 'reliability within limits' WHEN 5 THEN 'calibration degraded' WHEN 6 THEN 'performance degraded'
    WHEN 7 THEN 'degraded, labels insufficient for the action' ELSE 'ambiguous evidence' END AS reason,
  rule IN (5, 6, 7) AND NOT shift > 0.02e0 AS degraded_without_shift FROM rl""")
def dec1(t):
    return decide.decide(evidence(t), POLICY).select(*WINDOW, "rule", "action", "reason", "degraded_without_shift")


@query("dec2_least_invasive", f"""
WITH {SQL_EVIDENCE},
cand AS (SELECT lang, source, 'NO_ACTION' AS action, 0e0 AS cost, round(0.9e0 - perf_loss, 6) AS reliability FROM ev
  UNION ALL SELECT lang, source, 'RECALIBRATE', 1e0, round(0.95e0 - calibration_loss, 6) FROM ev
  UNION ALL SELECT lang, source, 'RETRAIN', 5e0, round(1.02e0 - bad_rate, 6) FROM ev),
ok AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY cost, action) AS rn FROM cand WHERE reliability >= 0.88e0),
w AS (SELECT DISTINCT lang, source FROM cand)
SELECT w.lang, w.source, COALESCE(ok.action, 'HOLD') AS action, cost, reliability FROM w LEFT JOIN ok ON ok.lang = w.lang AND ok.source = w.source AND rn = 1""")
def dec2(t):
    candidates = evidence(t).select(*WINDOW, F.inline(F.array(
        F.struct(F.lit("NO_ACTION").alias("action"), F.lit(0.0).alias("cost"), F.round(0.9 - F.col("perf_loss"), 6).alias("reliability")),
        F.struct(F.lit("RECALIBRATE").alias("action"), F.lit(1.0).alias("cost"), F.round(0.95 - F.col("calibration_loss"), 6).alias("reliability")),
        F.struct(F.lit("RETRAIN").alias("action"), F.lit(5.0).alias("cost"), F.round(1.02 - F.col("bad_rate"), 6).alias("reliability")),
    )))
    return decide.least_invasive(candidates, 0.88, WINDOW)


@query("dec3_label_sufficiency", f"""
WITH {SQL_QUALITY}, c AS (SELECT lang, source, COUNT(label) AS n_labels, CAST(SUM(CASE WHEN label = '0' THEN 1 ELSE 0 END) AS BIGINT) AS n_0,
  CAST(SUM(CASE WHEN label = '1' THEN 1 ELSE 0 END) AS BIGINT) AS n_1 FROM quality GROUP BY ALL)
SELECT *, least(n_0, n_1) AS min_class_labels, n_labels >= 10 AND least(n_0, n_1) >= 4 AS sufficient FROM c""")
def dec3(t):
    return decide.label_sufficiency(quality(t), ["0", "1"], 10, 4, WINDOW)


# ------------------------------------------------------------------ adapt

GRID = adapt.temperature_grid(0.05, 20.0, 25)
SQL_NLL = f"""grid AS (SELECT unnest([{", ".join(f"{g!r}e0" for g in GRID)}]) AS temperature),
lp AS (SELECT snapshot_year, label, ln(greatest(pa, 1e-12)) AS za, ln(greatest(pn, 1e-12)) AS zn, ln(greatest(pr, 1e-12)) AS zr FROM scored),
nl AS (SELECT snapshot_year, temperature, COUNT(*) AS n, AVG(ln(exp(za / temperature) + exp(zn / temperature) + exp(zr / temperature))
    - CASE label WHEN 'A' THEN za WHEN 'N' THEN zn ELSE zr END / temperature) AS nll FROM lp CROSS JOIN grid GROUP BY ALL)"""


@query("adp1_temperature", f"""
WITH {SQL_SCORED}, {SQL_NLL}
SELECT snapshot_year, temperature, round(nll, 6) AS nll, n, temperature IN ({min(GRID)!r}e0, {max(GRID)!r}e0) AS on_edge
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_year ORDER BY nll, temperature) AS rn FROM nl) WHERE rn = 1""")
def adp1(t):
    return adapt.fit_temperature(scored(t), CLASSES, GRID, [Y]).withColumn("nll", r("nll"))


@query("adp1_calibrated_brier", f"""
WITH {SQL_SCORED}, pw AS (SELECT snapshot_year, label, predicted, sqrt(greatest(pa, 1e-12)) AS a, sqrt(greatest(pn, 1e-12)) AS n, sqrt(greatest(pr, 1e-12)) AS r FROM scored),
q AS (SELECT snapshot_year, label, a / (a + n + r) AS pa, n / (a + n + r) AS pn, r / (a + n + r) AS pr FROM pw)
SELECT snapshot_year, COUNT(*) AS n, round(AVG(power(pa - CAST(label = 'A' AS INTEGER), 2)
  + power(pn - CAST(label = 'N' AS INTEGER), 2) + power(pr - CAST(label = 'R' AS INTEGER), 2)), 6) AS brier FROM q GROUP BY ALL""")
def adp1_brier(t):
    return brier(adapt.apply_temperature(scored(t), CLASSES, 2.0), CLASSES, [Y]).withColumn("brier", r("brier"))


@query("adp2_platt")
def adp2(t):
    ovr = assign_split(quality(t), "record_id", {"reference": 600, "adapt": 200, "verify": 200}, "frozen").where(
        "y is not null").select("record_id", "split", F.lit("1").alias("class"), "score", "y")
    a, b = adapt.fit_platt(ovr.where("split <> 'verify'"))
    held = ovr.where("split = 'verify'")
    after = adapt.apply_platt(held, a, b).withColumn("score", F.col("calibrated"))
    tag = lambda d, phase: d.select(F.lit(phase).alias("phase"), "n", r("ece"))
    return tag(ece(held), "before").unionByName(tag(ece(after), "after"))


ISO_BINS = 50


@query("adp3_isotonic", f"""
WITH {SQL_QUALITY}, b AS (SELECT least(CAST(floor(score * {ISO_BINS}) AS INTEGER), {ISO_BINS - 1}) AS bin, AVG(score) AS s, AVG(y) AS rate,
   CAST(COUNT(*) AS DOUBLE) AS w FROM quality WHERE y IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY bin) AS i, SUM(w) OVER (ORDER BY bin) AS cw, SUM(w * rate) OVER (ORDER BY bin) AS cs FROM b),
m AS (SELECT i.i, j.i AS j, MIN((k.cs - j.cs + j.w * j.rate) / (k.cw - j.cw + j.w)) AS lo
      FROM o i JOIN o j ON j.i <= i.i JOIN o k ON k.i >= i.i GROUP BY ALL),
f AS (SELECT i, MAX(lo) AS calibrated FROM m GROUP BY ALL)
SELECT bin, round(s, 6) AS score, round(rate, 6) AS rate, w AS weight, round(calibrated, 6) AS calibrated FROM o JOIN f USING (i)""")
def adp3(t):
    one = quality(t).select(F.lit("1").alias("class"), "score", "y")
    _, table = adapt.fit_isotonic(one, ISO_BINS)
    return table.select("bin", r("score"), r("rate"), "weight", r("calibrated"))


@query("adp4_retrained_candidate")
def adp4(t):
    data = text_data(t)
    model = training.retrain(data.where("split = 'adapt'"), "logistic", MODEL_FEATURES, classes=["0", "1"])
    held = training.score(data.where("split = 'verify'"), model, "2.0", ["0", "1"])
    return metrics_long(held, ["0", "1"], by=["model_version"], group_bound=2).withColumn("value", r("value"))


@query("adp5_reweight", f"""
WITH {SQL_COHORTS}, c AS (SELECT l_returnflag, l_linestatus, CAST(SUM(CASE WHEN snapshot_year = 1995 THEN 1 ELSE 0 END) AS BIGINT) AS n,
  SUM(CASE WHEN snapshot_year = 2000 THEN 1 ELSE 0 END) AS c FROM cohorts GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, round(c * SUM(n) OVER () / (SUM(c) OVER () * n), 6) AS weight FROM c WHERE n > 0""")
def adp5(t):
    rows = cohorts(t)
    weighted = adapt.reweight(rows.where(F.col(Y) == 1995), rows.where(F.col(Y) == 2000),
                              ["l_returnflag", "l_linestatus"], n_strata=100)
    return weighted.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


# ------------------------------------------------------------------ registry


def registry(t):
    """One model per nation; each year's order count decides whether its candidate passed."""
    yearly = t("orders").select("o_custkey", F.year("o_orderdate").alias("y")).groupBy("o_custkey", "y").agg(
        F.count("*").alias("n")).join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    ).groupBy(F.concat(F.lit("m"), F.col("c_nationkey")).alias("model_id"), "y").agg(F.sum("n").alias("n"))
    step = F.col("y") - 1995
    version = F.concat_ws(".", F.floor(step / 3).cast("int") + 1, step % 3)
    return yearly.select(
        "model_id", (step + 1).cast("bigint").alias("seq"), version.alias("version"), F.lit(None).cast("string").alias("parent"),
        F.when((F.col("y") == 1995) | (F.col("n") % 3 != 0), "PROMOTED").otherwise("REJECTED").alias("event"),
        F.make_date(F.col("y"), F.lit(12), F.lit(31)).alias("ts"), "n")


SQL_REGISTRY = """yearly AS (SELECT 'm' || c_nationkey AS model_id, CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
registry AS (SELECT model_id, CAST(y - 1994 AS BIGINT) AS seq, CAST((y - 1995) // 3 + 1 AS VARCHAR) || '.' || CAST((y - 1995) % 3 AS VARCHAR) AS version,
  CASE WHEN y = 1995 OR n % 3 <> 0 THEN 'PROMOTED' ELSE 'REJECTED' END AS event, make_date(y, 12, 31) AS ts, n FROM yearly),
promoted AS (SELECT *, lag(version) OVER (PARTITION BY model_id ORDER BY seq) AS prev,
   row_number() OVER (PARTITION BY model_id ORDER BY seq DESC) AS back FROM registry WHERE event = 'PROMOTED'),
top AS (SELECT model_id, MAX(seq) AS top_seq FROM registry GROUP BY ALL),
want AS (SELECT model_id, CASE WHEN n % 2 = 0 THEN 'RECALIBRATE' ELSE 'RETRAIN' END AS action, n FROM yearly WHERE y = 2000),
st AS (SELECT p.model_id, p.version AS active, CAST(split_part(p.version, '.', 1) AS INTEGER) AS amaj FROM promoted p WHERE back = 1),
nv AS (SELECT w.model_id, w.action, w.n, active AS parent, CASE WHEN action = 'RECALIBRATE' THEN amaj || '.' ||
    (SELECT MAX(CAST(split_part(version, '.', 2) AS INTEGER)) + 1 FROM registry r WHERE r.model_id = w.model_id AND CAST(split_part(version, '.', 1) AS INTEGER) = amaj)
  ELSE (SELECT MAX(CAST(split_part(version, '.', 1) AS INTEGER)) + 1 FROM registry r WHERE r.model_id = w.model_id) || '.0' END AS version
  FROM want w JOIN st USING (model_id))"""


def candidates(t, reg):
    wanted = reg.where(F.year("ts") == 2000).select(
        "model_id", F.when(F.col("n") % 2 == 0, "RECALIBRATE").otherwise("RETRAIN").alias("action"), F.col("n").alias("n0"))
    return adapt.next_version(reg, wanted.drop("n0")).join(wanted.select("model_id", "n0"), "model_id")


@query("adp6_next_version", f"WITH {SQL_REGISTRY} SELECT model_id, action, parent, version FROM nv")
def adp6(t):
    return candidates(t, registry(t)).drop("n0", "reason")


@query("ver1_split_isolation", f"""
WITH h AS (SELECT o_orderkey, {sql_hash("'frozen|' || o_orderkey")} % 1000 AS h, {sql_hash("'other|' || o_orderkey")} % 1000 AS g FROM orders)
SELECT 'same seed' AS pair, CAST(SUM(CASE WHEN h >= 600 AND h < 850 AND h >= 850 THEN 1 ELSE 0 END) AS BIGINT) AS n_overlap, true AS isolated FROM h
UNION ALL SELECT 'different seeds', CAST(SUM(CASE WHEN h >= 600 AND h < 850 AND g >= 850 THEN 1 ELSE 0 END) AS BIGINT),
  SUM(CASE WHEN h >= 600 AND h < 850 AND g >= 850 THEN 1 ELSE 0 END) = 0 FROM h""")
def ver1(t):
    weights = {"reference": 600, "adapt": 250, "verify": 150}
    frozen = assign_split(t("orders").select("o_orderkey"), "o_orderkey", weights, "frozen")
    other = assign_split(t("orders").select("o_orderkey"), "o_orderkey", weights, "other")
    adapt_rows = frozen.where("split = 'adapt'")
    good = verify.assert_disjoint(adapt_rows, frozen.where("split = 'verify'"), "o_orderkey").withColumn("pair", F.lit("same seed"))
    bad = verify.assert_disjoint(adapt_rows, other.where("split = 'verify'"), "o_orderkey").withColumn("pair", F.lit("different seeds"))
    return good.unionByName(bad)


CRITERIA = [("RECALIBRATE", "ece", "A", "absolute", 0.35), ("RECALIBRATE", "brier", "all", "relative", 0.0),
            ("RETRAIN", "ece", "A", "absolute", 0.35), ("RETRAIN", "brier", "all", "relative", -0.02), ("RETRAIN", "ece", "R", "relative", 0.01)]

SQL_GATE = f"""pw AS (SELECT snapshot_year, label, sqrt(greatest(pa, 1e-12)) AS a, sqrt(greatest(pn, 1e-12)) AS n, sqrt(greatest(pr, 1e-12)) AS r FROM scored),
q AS (SELECT snapshot_year, label, a / (a + n + r) AS pa, n / (a + n + r) AS pn, r / (a + n + r) AS pr FROM pw),
covr AS (SELECT snapshot_year, 'A' AS class, pa AS score, CAST(label = 'A' AS INTEGER) AS y FROM q
   UNION ALL SELECT snapshot_year, 'N', pn, CAST(label = 'N' AS INTEGER) FROM q UNION ALL SELECT snapshot_year, 'R', pr, CAST(label = 'R' AS INTEGER) FROM q),
{SQL_RELTAB.format(g="snapshot_year, class", src="ovr")},
crt AS ({SQL_RELTAB.format(g="snapshot_year, class", src="covr").strip().removeprefix("rt AS (")},
act AS (SELECT snapshot_year, 'ece' AS metric, class, SUM(abs(s - o) * n) / SUM(n) AS value FROM rt GROUP BY ALL
  UNION ALL SELECT snapshot_year, 'brier', 'all', AVG(power(pa - CAST(label = 'A' AS INTEGER), 2) + power(pn - CAST(label = 'N' AS INTEGER), 2)
    + power(pr - CAST(label = 'R' AS INTEGER), 2)) FROM scored GROUP BY snapshot_year),
can AS (SELECT snapshot_year, 'ece' AS metric, class, SUM(abs(s - o) * n) / SUM(n) AS value FROM crt GROUP BY ALL
  UNION ALL SELECT snapshot_year, 'brier', 'all', AVG(power(pa - CAST(label = 'A' AS INTEGER), 2) + power(pn - CAST(label = 'N' AS INTEGER), 2)
    + power(pr - CAST(label = 'R' AS INTEGER), 2)) FROM q GROUP BY snapshot_year),
crit(action, metric, class, kind, lim) AS (VALUES {", ".join(f"('{a}', '{m}', '{c}', '{k}', {x}e0)" for a, m, c, k, x in CRITERIA)}),
det AS (SELECT y.snapshot_year, c.action, CASE WHEN kind = 'absolute' THEN can.value <= lim ELSE can.value - act.value <= lim END AS passed
  FROM (SELECT DISTINCT snapshot_year, CASE WHEN snapshot_year % 2 = 1 THEN 'RECALIBRATE' ELSE 'RETRAIN' END AS action FROM scored) y
  JOIN crit c ON c.action = y.action JOIN can ON can.snapshot_year = y.snapshot_year AND can.metric = c.metric AND can.class = c.class
  JOIN act ON act.snapshot_year = y.snapshot_year AND act.metric = c.metric AND act.class = c.class)"""


def _ece_and_brier(rows):
    ovr = one_vs_rest(rows, CLASSES, [Y])
    return ece(ovr, by=[Y]).select(Y, F.lit("ece").alias("metric"), "class", F.col("ece").alias("value")).unionByName(
        brier(rows, CLASSES, [Y]).select(Y, F.lit("brier").alias("metric"), F.lit("all").alias("class"), F.col("brier").alias("value")))


@query("ver2_gate", f"""
WITH {SQL_OVR}, {SQL_GATE}
SELECT snapshot_year, action, COUNT(*) AS n_criteria, CAST(SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS n_failed, bool_and(passed) AS passed
FROM det GROUP BY ALL""")
def ver2(t):
    active = _ece_and_brier(scored(t))
    action = F.when(F.col(Y) % 2 == 1, "RECALIBRATE").otherwise("RETRAIN")
    candidate = _ece_and_brier(adapt.apply_temperature(scored(t), CLASSES, 2.0)).withColumn("action", action)
    criteria = literal_table(t.spark, CRITERIA, "action string, metric string, class string, kind string, limit double")
    return verify.gate(candidate, active, criteria, [Y], n_criteria=len(CRITERIA))


def verdicts(t, reg):
    return candidates(t, reg).select(
        "model_id", "version", "parent", (F.col("n0") % 5 != 0).alias("passed"), F.lit("2002-06-30").cast("date").alias("ts"))


@query("ver3_apply_gate", f"""
WITH {SQL_REGISTRY}
SELECT model_id, top_seq + 1 AS seq, version, parent, CASE WHEN n % 5 <> 0 THEN 'PROMOTED' ELSE 'REJECTED' END AS event, DATE '2002-06-30' AS ts
FROM nv JOIN top USING (model_id)""")
def ver3(t):
    reg = registry(t)
    return verify.apply_gate(reg, verdicts(t, reg))


@query("ver3_active_version", f"""
WITH {SQL_REGISTRY}, al AS (SELECT model_id, seq, version, event, ts FROM registry
  UNION ALL SELECT model_id, top_seq + 1, version, CASE WHEN n % 5 <> 0 THEN 'PROMOTED' ELSE 'REJECTED' END, DATE '2002-06-30' FROM nv JOIN top USING (model_id))
SELECT 'now' AS as_of, model_id, max_by(version, seq) AS active_version, max_by(ts, seq) AS active_since FROM al WHERE event = 'PROMOTED' GROUP BY ALL
UNION ALL SELECT '1999-06-30', model_id, max_by(version, seq), max_by(ts, seq) FROM al WHERE event = 'PROMOTED' AND ts <= DATE '1999-06-30' GROUP BY ALL""")
def ver3_active(t):
    reg = registry(t)
    events = reg.drop("n").unionByName(verify.apply_gate(reg, verdicts(t, reg)))
    now = verify.active_version(events).withColumn("as_of", F.lit("now"))
    then = verify.active_version(events, F.lit("1999-06-30").cast("date")).withColumn("as_of", F.lit("1999-06-30"))
    return now.unionByName(then)


@query("ver4_rollback", f"""
WITH {SQL_REGISTRY}
SELECT model_id, top_seq + 1 AS seq, prev AS version, version AS parent, 'ROLLBACK' AS event, DATE '2002-07-01' AS ts
FROM promoted JOIN top USING (model_id) WHERE back = 1 AND prev IS NOT NULL""")
def ver4(t):
    return verify.rollback(registry(t), F.lit("2002-07-01").cast("date"))


@query("ver5_version_history", f"""
WITH {SQL_REGISTRY}
SELECT model_id, version, event, ts AS valid_from, lead(ts) OVER (PARTITION BY model_id ORDER BY seq) AS valid_to,
  CAST(row_number() OVER (PARTITION BY model_id ORDER BY seq) AS INTEGER) AS activation FROM promoted""")
def ver5(t):
    return verify.version_history(registry(t))
