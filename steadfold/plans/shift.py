"""Shift monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_mille
from ..operators import shift as m
from ..operators import sketches
from ..session import literal_table, materialize
from .registry import query
from .views import (
    CLASSES, FEATURES, PROBS, REF_YEAR, SQL_COHORTS, SQL_OVR, SQL_QUALITY, SQL_SCORED, cohorts, quality, r,
    scored, sql_hash, sql_long,
)

Y = "snapshot_year"
EDGE_LIST = "[" + ", ".join(f"{p}e0" for p in PROBS) + "]"


def stressed(t):
    """Cohorts with known faults in later years (the given tables hold no NULL)."""
    later = F.col(Y) >= 1998
    return cohorts(t).withColumns({
        "l_quantity": F.when(~(later & (hash_mille("s1", "gap", F.col("record_id")) < 80)), F.col("l_quantity")),
        "l_extendedprice": F.when((F.col(Y) >= 1999) & (hash_mille("s1", "spike", F.col("record_id")) < 30),
                                  F.col("l_extendedprice") * 10.0).otherwise(F.col("l_extendedprice")),
        "l_tax": F.when(F.col(Y) != 2000, F.col("l_tax")),
    })


def years(t):
    """The years in the table and the reference year; a row without a date is in none."""
    return sorted({REF_YEAR, *m.window_values(cohorts(t).where(F.col(Y).isNotNull()), Y)})


def reference(df, by=()):
    """Long form of the reference year only; the filter comes first and reaches the scan."""
    return m.to_long(df, FEATURES, Y, by, windows=[REF_YEAR])


SQL_STRESSED = SQL_COHORTS + f""",
stressed AS (
  SELECT record_id, snapshot_year, l_returnflag, l_linestatus,
    CASE WHEN NOT (snapshot_year >= 1998 AND {sql_hash("'s1|gap|' || record_id")} % 1000 < 80) THEN l_quantity END AS l_quantity,
    CASE WHEN snapshot_year >= 1999 AND {sql_hash("'s1|spike|' || record_id")} % 1000 < 30
         THEN l_extendedprice * 10e0 ELSE l_extendedprice END AS l_extendedprice,
    l_discount,
    CASE WHEN snapshot_year <> 2000 THEN l_tax END AS l_tax
  FROM cohorts)"""


def sql_psi(groups: str = "feature") -> str:
    """CTEs from ``long(snapshot_year, <groups>, value)`` to ``psi_all(…, n, n_missing, psi)``."""
    return f""",
edges AS (SELECT {groups}, quantile_cont(value, {EDGE_LIST}) AS e FROM long
          WHERE snapshot_year = {REF_YEAR} AND value IS NOT NULL GROUP BY {groups}),
binned AS (SELECT snapshot_year, {groups}, value,
             CASE WHEN value IS NOT NULL THEN len(list_filter(e, lambda x: x < value)) END AS bin
           FROM long LEFT JOIN edges USING ({groups})),
sizes AS (SELECT snapshot_year, {groups}, COUNT(*) AS n, COUNT(*) - COUNT(value) AS n_missing, COUNT(value) AS m
          FROM binned GROUP BY ALL),
cells AS (SELECT s.snapshot_year, {", ".join("s." + g.strip() for g in groups.split(","))}, b.bin, s.m
          FROM sizes s CROSS JOIN (SELECT unnest(range(10)) AS bin) b),
filled AS (SELECT c.*, COALESCE(k.c, 0) AS c FROM cells c
           LEFT JOIN (SELECT snapshot_year, {groups}, bin, COUNT(*) AS c FROM binned WHERE bin IS NOT NULL GROUP BY ALL) k
           USING (snapshot_year, {groups}, bin)),
shares AS (SELECT *, CASE WHEN m > 0 THEN greatest(c / CAST(m AS DOUBLE), 1e-4) END AS share FROM filled),
psi_only AS (SELECT q.snapshot_year, {", ".join("q." + g.strip() for g in groups.split(","))},
               SUM((q.share - p.share) * ln(q.share / p.share)) AS psi
             FROM shares q JOIN (SELECT * FROM shares WHERE snapshot_year = {REF_YEAR}) p USING ({groups}, bin)
             GROUP BY ALL),
psi_all AS (SELECT s.*, psi FROM sizes s JOIN psi_only USING (snapshot_year, {groups}))"""


SQL_MON1 = f"""
WITH {SQL_COHORTS}, long AS ({sql_long("cohorts", FEATURES, Y)}){sql_psi()}
SELECT snapshot_year AS year, feature, n, round(n_missing / CAST(n AS DOUBLE), 6) AS missing_rate, round(psi, 6) AS psi
FROM psi_all WHERE snapshot_year <> {REF_YEAR}"""


@query("mon1_psi_numeric", SQL_MON1)
def mon1(t):
    long = m.to_long(cohorts(t), FEATURES, Y)
    edges = m.fit_edges(reference(cohorts(t)), group_bound=len(FEATURES))
    out = m.psi(long, edges, REF_YEAR, Y, group_bound=len(FEATURES))
    return out.select(F.col(Y).alias("year"), "feature", "n", r("missing_rate"), r("psi"))


@query("mon1_psi_bracket_edges", SQL_MON1)
def mon1_bracket(t):
    """The same report with exact edges found by passes over the rows: bins are shuffled, never values."""
    long = m.to_long(cohorts(t), FEATURES, Y)
    edges = m.fit_edges(reference(cohorts(t)), method="bracket", group_bound=len(FEATURES))
    out = m.psi(long, edges, REF_YEAR, Y, group_bound=len(FEATURES))
    return out.select(F.col(Y).alias("year"), "feature", "n", r("missing_rate"), r("psi"))


@query("mon1_psi_with_faults", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, Y)}){sql_psi()},
ref AS (SELECT feature, n_missing / CAST(n AS DOUBLE) AS ref_rate FROM psi_all WHERE snapshot_year = {REF_YEAR})
SELECT snapshot_year AS year, feature, n, round(n_missing / CAST(n AS DOUBLE), 6) AS missing_rate,
       round(n_missing / CAST(n AS DOUBLE) - ref_rate, 6) AS missing_change, round(psi, 6) AS psi
FROM psi_all JOIN ref USING (feature) WHERE snapshot_year <> {REF_YEAR}""")
def mon1_faults(t):
    long = m.to_long(stressed(t), FEATURES, Y)
    edges = m.fit_edges(reference(stressed(t)), group_bound=len(FEATURES))
    out = m.psi(long, edges, REF_YEAR, Y, group_bound=len(FEATURES))
    return out.select(F.col(Y).alias("year"), "feature", "n", r("missing_rate"), r("missing_change"), r("psi"))


def sql_cdf() -> str:
    return f""",
windows AS (SELECT DISTINCT snapshot_year AS w FROM long WHERE snapshot_year <> {REF_YEAR}),
pairs AS (SELECT w, feature, value, SUM(CASE WHEN snapshot_year = {REF_YEAR} THEN 1 ELSE 0 END) AS a,
            SUM(CASE WHEN snapshot_year = w THEN 1 ELSE 0 END) AS b
          FROM long JOIN windows ON snapshot_year IN ({REF_YEAR}, w) WHERE value IS NOT NULL GROUP BY ALL),
cdf AS (SELECT w, feature, value, SUM(a) OVER o AS ca, SUM(b) OVER o AS cb, SUM(a) OVER g AS na, SUM(b) OVER g AS nb,
          lead(value) OVER o AS nx
        FROM pairs WINDOW o AS (PARTITION BY w, feature ORDER BY value), g AS (PARTITION BY w, feature)),
dist AS (SELECT w, feature, CAST(MAX(na) AS BIGINT) AS n_ref, CAST(MAX(nb) AS BIGINT) AS n_cur,
           MAX(abs(cb / CAST(nb AS DOUBLE) - ca / CAST(na AS DOUBLE))) AS ks,
           SUM(abs(cb / CAST(nb AS DOUBLE) - ca / CAST(na AS DOUBLE)) * COALESCE(nx - value, 0e0)) AS w1
         FROM cdf GROUP BY ALL)"""


SQL_CDF_DRIFT = f"""
WITH {SQL_COHORTS},
moved AS (SELECT snapshot_year, l_quantity + CASE WHEN snapshot_year >= 2000 THEN 3e0 ELSE 0e0 END AS l_quantity,
            l_extendedprice, l_discount, l_tax FROM cohorts),
long AS ({sql_long("moved", FEATURES, Y)})""" + sql_cdf()


def drifted(t):
    return cohorts(t).withColumn("l_quantity", F.col("l_quantity") + F.when(F.col(Y) >= 2000, 3.0).otherwise(0.0))


@query("mon2_ks", SQL_CDF_DRIFT + " SELECT w AS year, feature, n_ref, n_cur, round(ks, 6) AS ks FROM dist")
def mon2(t):
    found = years(t)
    long = m.to_long(drifted(t), FEATURES, Y, windows=found)
    return m.ks(long, found, REF_YEAR, window=Y, group_bound=len(FEATURES)).select(
        F.col(Y).alias("year"), "feature", "n_ref", "n_cur", r("ks"))


@query("mon3_wasserstein", SQL_CDF_DRIFT + " SELECT w AS year, feature, n_ref, n_cur, round(w1, 5) AS w1 FROM dist")
def mon3(t):
    found = years(t)
    long = m.to_long(drifted(t), FEATURES, Y, windows=found)
    return m.wasserstein1(long, found, REF_YEAR, window=Y, group_bound=len(FEATURES)).select(
        F.col(Y).alias("year"), "feature", "n_ref", "n_cur", r("w1", 5))


@query("mon4_missingness", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, Y)}),
rates AS (SELECT snapshot_year, feature, COUNT(*) AS n, COUNT(*) - COUNT(value) AS n_missing,
            (COUNT(*) - COUNT(value)) / CAST(COUNT(*) AS DOUBLE) AS rate FROM long GROUP BY ALL)
SELECT a.snapshot_year AS year, feature, a.n, a.n_missing, round(a.rate, 6) AS missing_rate,
       round(a.rate - b.rate, 6) AS missing_change
FROM rates a JOIN (SELECT feature, rate FROM rates WHERE snapshot_year = {REF_YEAR}) b USING (feature)""")
def mon4(t):
    return m.missingness(stressed(t), FEATURES, REF_YEAR, Y).select(
        F.col(Y).alias("year"), "feature", "n", "n_missing", r("missing_rate"), r("missing_change"))


BOUNDS = [("l_quantity", 1.0, 50.0), ("l_extendedprice", 0.0, 105000.0), ("l_discount", 0.0, 0.08), ("l_tax", 0.0, 0.08)]


@query("mon5_out_of_range", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, Y)}),
bounds(feature, lo, hi) AS (VALUES {", ".join(f"('{f}', {lo}e0, {hi}e0)" for f, lo, hi in BOUNDS)})
SELECT snapshot_year AS year, feature, COUNT(value) AS n,
       CAST(SUM(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_out,
       round(AVG(CASE WHEN value < lo OR value > hi THEN 1e0 WHEN value IS NOT NULL THEN 0e0 END), 6) AS out_rate
FROM long LEFT JOIN bounds USING (feature) GROUP BY ALL""")
def mon5(t):
    bounds = literal_table(t.spark, BOUNDS, "feature string, lo double, hi double")
    long = m.to_long(stressed(t), FEATURES, Y)
    return m.out_of_range(long, bounds, Y, n_bounds=len(BOUNDS)).select(
        F.col(Y).alias("year"), "feature", "n", "n_out", r("out_rate"))


SQL_LABEL_SHIFT = """
SELECT q.{y} AS {y}, CAST(SUM(q.c) AS BIGINT) AS n_labels, MAX(abs(q.share - p.share)) AS max_share_change,
       SUM((greatest(q.share, 1e-4) - greatest(p.share, 1e-4)) * ln(greatest(q.share, 1e-4) / greatest(p.share, 1e-4))) AS psi
FROM {t} q JOIN {t} p ON p.class = q.class AND p.{y} = {ref} WHERE q.{y} <> {ref} GROUP BY q.{y}"""


def sql_class_shares(source: str, column: str, y: str = Y) -> str:
    """(y, class, c, share) over every class seen anywhere, absent ones as zero."""
    return f"""
SELECT w.{y}, k.class, COALESCE(c, 0) AS c, COALESCE(c, 0) / CAST(SUM(COALESCE(c, 0)) OVER (PARTITION BY w.{y}) AS DOUBLE) AS share
FROM (SELECT DISTINCT {y} FROM {source}) w CROSS JOIN (SELECT DISTINCT {column} AS class FROM {source} WHERE {column} IS NOT NULL) k
LEFT JOIN (SELECT {y}, {column} AS class, COUNT(*) AS c FROM {source} GROUP BY ALL) n ON n.{y} = w.{y} AND n.class = k.class"""


@query("mon6_prediction_shift", f"""
WITH {SQL_SCORED}, long AS (SELECT snapshot_year, 'score' AS feature, pa AS value FROM scored){sql_psi()},
cs AS ({sql_class_shares("scored", "predicted")}), ls AS ({SQL_LABEL_SHIFT.format(y=Y, t="cs", ref=REF_YEAR)})
SELECT snapshot_year AS year, 'score' AS signal, round(psi, 6) AS psi FROM psi_all WHERE snapshot_year <> {REF_YEAR}
UNION ALL SELECT snapshot_year, 'predicted_class', round(psi, 6) FROM ls""")
def mon6(t):
    preds = scored(t).withColumn("score", F.col("probs")["A"])
    return m.prediction_shift(preds, years(t), REF_YEAR, window=Y).select(F.col(Y).alias("year"), "signal", r("psi"))


@query("mon7_psi_categorical", f"""
WITH {SQL_COHORTS},
rec AS (SELECT snapshot_year, CASE WHEN snapshot_year >= 2000 AND l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS l_returnflag,
          l_linestatus FROM cohorts),
fs AS ({sql_class_shares("(SELECT snapshot_year, COALESCE(l_returnflag, '(missing)') AS v FROM rec)", "v")}),
ls AS ({sql_class_shares("rec", "l_linestatus")}),
both_f AS (SELECT 'l_returnflag' AS feature, * FROM fs UNION ALL SELECT 'l_linestatus', * FROM ls)
SELECT q.snapshot_year AS year, q.feature, COUNT(*) AS n_categories,
  round(SUM((greatest(q.share, 1e-4) - greatest(p.share, 1e-4)) * ln(greatest(q.share, 1e-4) / greatest(p.share, 1e-4))), 6) AS psi
FROM both_f q JOIN both_f p ON p.feature = q.feature AND p.class = q.class AND p.snapshot_year = {REF_YEAR}
WHERE q.snapshot_year <> {REF_YEAR} AND (q.c > 0 OR p.c > 0) GROUP BY ALL""")
def mon7(t):
    rec = cohorts(t).withColumn(
        "l_returnflag", F.when(~((F.col(Y) >= 2000) & (F.col("l_returnflag") == "A")), F.col("l_returnflag")))
    long = m.to_long_categorical(rec, ["l_returnflag", "l_linestatus"], Y)
    return m.psi_categorical(long, years(t), REF_YEAR, Y).select(F.col(Y).alias("year"), "feature", "n_categories", r("psi"))


@query("mon8_data_quality", f"""
WITH base AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey, l_linenumber, l_discount, l_linestatus, l_tax FROM lineitem),
dup AS (SELECT year, SUM(c - 1) AS bad FROM (SELECT year, l_orderkey, l_linenumber, COUNT(*) AS c FROM base GROUP BY ALL) GROUP BY year),
one AS (SELECT year, COUNT(*) AS n, SUM(CASE WHEN l_discount > 0.09e0 THEN 1 ELSE 0 END) AS b1,
          SUM(CASE WHEN l_linestatus NOT IN ('O') THEN 1 ELSE 0 END) AS b2, SUM(CASE WHEN l_tax < 0 THEN 1 ELSE 0 END) AS b3
        FROM base GROUP BY year),
ind AS (SELECT year, n, 'duplicate_id' AS indicator, bad FROM one JOIN dup USING (year)
        UNION ALL SELECT year, n, 'discount_domain', b1 FROM one UNION ALL SELECT year, n, 'status_domain', b2 FROM one
        UNION ALL SELECT year, n, 'negative_tax', b3 FROM one)
SELECT year, n, indicator, CAST(bad AS BIGINT) AS n_bad, round(bad / CAST(n AS DOUBLE), 6) AS bad_rate FROM ind""")
def mon8(t):
    base = t("lineitem").withColumn("year", F.year("l_shipdate"))
    rules = {
        "discount_domain": F.col("l_discount") > 0.09,
        "status_domain": ~F.col("l_linestatus").isin("O"),
        "negative_tax": F.col("l_tax") < 0,
    }
    return m.dq_indicators(base, ["l_orderkey", "l_linenumber"], rules, "year").select(
        "year", "n", "indicator", "n_bad", r("bad_rate"))


@query("mon9_availability", f"""
WITH {SQL_STRESSED},
seen AS (SELECT snapshot_year AS year, COUNT(l_quantity) AS q, COUNT(l_tax) AS x FROM stressed GROUP BY ALL)
SELECT year, 'l_quantity' AS feature, 'all null' AS reason FROM seen WHERE q = 0
UNION ALL SELECT year, 'l_tax', 'all null' FROM seen WHERE x = 0
UNION ALL SELECT year, 'meals_per_day', 'column absent' FROM seen""")
def mon9(t):
    return m.availability(stressed(t), ["l_quantity", "l_tax", "meals_per_day"], Y).select(
        F.col(Y).alias("year"), "feature", "reason")


@query("mon10_label_shift", f"""
WITH {SQL_COHORTS}, rec AS (SELECT snapshot_year, l_returnflag AS label FROM cohorts
   WHERE NOT (snapshot_year = 1999 AND l_returnflag = 'R' AND {sql_hash("'s1|drop|' || record_id")} % 1000 < 700)),
cs AS ({sql_class_shares("rec", "label")}), ls AS ({SQL_LABEL_SHIFT.format(y=Y, t="cs", ref=REF_YEAR)})
SELECT snapshot_year AS year, n_labels, round(max_share_change, 6) AS max_share_change, round(psi, 6) AS psi FROM ls""")
def mon10(t):
    gone = (F.col(Y) == 1999) & (F.col("l_returnflag") == "R") & (hash_mille("s1", "drop", F.col("record_id")) < 700)
    rec = cohorts(t).where(~gone).withColumnRenamed("l_returnflag", "label")
    return m.label_shift(rec, years(t), REF_YEAR, window=Y).select(
        F.col(Y).alias("year"), "n_labels", r("max_share_change"), r("psi"))


@query("mon10_class_shares", f"""
WITH {SQL_COHORTS}, cs AS ({sql_class_shares("cohorts", "l_returnflag")})
SELECT q.snapshot_year AS year, q.class, q.c AS n, round(q.share, 6) AS share, round(q.share - p.share, 6) AS share_change
FROM cs q JOIN cs p ON p.class = q.class AND p.snapshot_year = {REF_YEAR} WHERE q.snapshot_year <> {REF_YEAR}""")
def mon10_shares(t):
    return m.class_share(cohorts(t), "l_returnflag", years(t), REF_YEAR, Y).select(
        F.col(Y).alias("year"), "class", "n", r("share"), r("share_change"))


SQL_CONCEPT = f"""
bins AS (SELECT snapshot_year, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, COUNT(*) AS n, SUM(y) AS pos
         FROM ovr WHERE class = 'A' GROUP BY ALL),
concept AS (SELECT q.snapshot_year, CAST(SUM(q.n) AS BIGINT) AS n_labelled,
    CAST(SUM(CASE WHEN p.n IS NOT NULL THEN q.n ELSE 0 END) AS BIGINT) AS n_comparable,
    SUM(abs(q.pos / CAST(q.n AS DOUBLE) - p.pos / CAST(p.n AS DOUBLE)) * q.n)
      / SUM(CASE WHEN p.n IS NOT NULL THEN q.n END) AS concept_gap
  FROM bins q LEFT JOIN (SELECT * FROM bins WHERE snapshot_year = {REF_YEAR}) p USING (bin)
  WHERE q.snapshot_year <> {REF_YEAR} GROUP BY ALL)"""


@query("mon11_concept_evidence", f"""
WITH {SQL_OVR}, {SQL_CONCEPT}
SELECT snapshot_year AS year, n_labelled, n_comparable, round(concept_gap, 6) AS concept_gap FROM concept""")
def mon11(t):
    one = scored(t).select(Y, F.col("probs")["A"].alias("score"), (F.col("label") == "A").cast("int").alias("y"))
    return m.concept_evidence(one, REF_YEAR, window=Y).select(
        F.col(Y).alias("year"), "n_labelled", "n_comparable", r("concept_gap"))


@query("mon12_shift_verdict", f"""
WITH {SQL_OVR}, {SQL_CONCEPT}, long AS ({sql_long("cohorts", FEATURES, Y)}){sql_psi()},
cs AS ({sql_class_shares("cohorts", "l_returnflag")}), ls AS ({SQL_LABEL_SHIFT.format(y=Y, t="cs", ref=REF_YEAR)}),
ev AS (SELECT snapshot_year AS year, MAX(p.psi) AS max_psi, ANY_VALUE(ls.psi) AS label_psi,
         ANY_VALUE(concept_gap) AS concept_gap, ANY_VALUE(n_labelled) AS n_labelled
       FROM psi_all p JOIN ls USING (snapshot_year) JOIN concept USING (snapshot_year) GROUP BY ALL),
fl AS (SELECT *, max_psi > 0.004e0 AS cov, label_psi > 0.0005e0 AS lab, concept_gap > 0.02e0 AS con FROM ev)
SELECT year, cov AS covariate_shift, lab AS label_shift, con AS concept_shift,
       CASE WHEN con THEN 'concept' WHEN lab THEN 'label' WHEN cov THEN 'covariate' ELSE 'none' END AS verdict
FROM fl""")
def mon12(t):
    long = m.to_long(cohorts(t), FEATURES, Y)
    edges = m.fit_edges(reference(cohorts(t)), group_bound=len(FEATURES))
    inputs = m.psi(long, edges, REF_YEAR, Y, group_bound=len(FEATURES)).groupBy(Y).agg(F.max("psi").alias("max_psi"))
    labels = m.label_shift(cohorts(t), years(t), REF_YEAR, "l_returnflag", Y).select(Y, F.col("psi").alias("label_psi"))
    one = scored(t).select(Y, F.col("probs")["A"].alias("score"), (F.col("label") == "A").cast("int").alias("y"))
    evidence = inputs.join(labels, Y).join(m.concept_evidence(one, REF_YEAR, window=Y), Y)
    return m.classify_shift(evidence, 0.004, 0.0005, 0.02, 100).select(
        F.col(Y).alias("year"), "covariate_shift", "label_shift", "concept_shift", "verdict")


@query("mon13_annual_shift", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, Y)}),
edges AS (SELECT snapshot_year AS ey, feature, quantile_cont(value, {EDGE_LIST}) AS e FROM long WHERE value IS NOT NULL GROUP BY ALL),
binned AS (SELECT ey, snapshot_year, feature, len(list_filter(e, lambda x: x < value)) AS bin
           FROM long JOIN edges USING (feature) WHERE snapshot_year IN (ey, ey + 1) AND value IS NOT NULL),
rowsum AS (SELECT snapshot_year, feature, COUNT(*) AS n_all FROM long GROUP BY ALL),
cells AS (SELECT ey, feature, s.snapshot_year, bin, m FROM
            (SELECT ey, feature, snapshot_year, COUNT(*) AS m FROM binned GROUP BY ALL) s CROSS JOIN (SELECT unnest(range(10)) AS bin)),
shares AS (SELECT c.ey, c.feature, c.snapshot_year, c.bin, greatest(COALESCE(k, 0) / CAST(m AS DOUBLE), 1e-4) AS share FROM cells c
           LEFT JOIN (SELECT ey, feature, snapshot_year, bin, COUNT(*) AS k FROM binned GROUP BY ALL) USING (ey, feature, snapshot_year, bin)),
p AS (SELECT a.feature, a.ey, SUM((b.share - a.share) * ln(b.share / a.share)) AS psi
      FROM shares a JOIN shares b ON a.ey = b.ey AND a.feature = b.feature AND a.bin = b.bin
       AND a.snapshot_year = a.ey AND b.snapshot_year = a.ey + 1 GROUP BY ALL)
SELECT p.feature, CAST(ey AS INTEGER) AS prev_year, CAST(ey + 1 AS INTEGER) AS year, a.n_all AS n_prev, b.n_all AS n, round(psi, 6) AS psi
FROM p JOIN rowsum a ON a.feature = p.feature AND a.snapshot_year = ey JOIN rowsum b ON b.feature = p.feature AND b.snapshot_year = ey + 1""")
def mon13(t):
    return m.annual_shift(stressed(t), FEATURES).withColumn("psi", r("psi"))


@query("mon14_subgroup_psi", f"""
WITH {SQL_COHORTS}, long AS ({sql_long("cohorts", FEATURES, Y + ", l_returnflag")}){sql_psi("feature, l_returnflag")}
SELECT snapshot_year AS year, feature, l_returnflag AS subgroup, n, round(psi, 6) AS psi
FROM psi_all WHERE snapshot_year <> {REF_YEAR}""")
def mon14(t):
    bound = len(FEATURES) * len(CLASSES)
    long = m.to_long(cohorts(t), FEATURES, Y, by=["l_returnflag"])
    edges = m.fit_edges(reference(cohorts(t), ["l_returnflag"]), ["feature", "l_returnflag"], group_bound=bound)
    return m.psi(long, edges, REF_YEAR, Y, by=["l_returnflag"], group_bound=bound).select(
        F.col(Y).alias("year"), "feature", F.col("l_returnflag").alias("subgroup"), "n", r("psi"))


@query("mon14_subgroup_ks", f"""
WITH {SQL_QUALITY},
long AS (SELECT source AS feature, lang AS l, word_ratio AS value FROM quality),
pairs AS (SELECT w.l AS w, feature, value, SUM(CASE WHEN long.l = 'en' THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN long.l = w.l THEN 1 ELSE 0 END) AS b
          FROM long JOIN (SELECT DISTINCT l FROM long WHERE l <> 'en') w ON long.l IN ('en', w.l) GROUP BY ALL),
cdf AS (SELECT w, feature, SUM(a) OVER o AS ca, SUM(b) OVER o AS cb, SUM(a) OVER g AS na, SUM(b) OVER g AS nb
        FROM pairs WINDOW o AS (PARTITION BY w, feature ORDER BY value), g AS (PARTITION BY w, feature))
SELECT w AS lang, feature AS source, round(MAX(abs(cb / CAST(nb AS DOUBLE) - ca / CAST(na AS DOUBLE))), 6) AS ks
FROM cdf WHERE na > 0 AND nb > 0 GROUP BY ALL""")
def mon14_ks(t):
    langs = m.window_values(t("documents"), "lang")
    long = m.to_long(quality(t), ["word_ratio"], "lang", by=["source"])
    return m.ks(long, langs, "en", window="lang", by=["source"]).where(F.col("ks").isNotNull()).select(
        "lang", "source", r("ks"))


@query("mon1_psi_sketch_edges")
def mon1_sketch(t):
    """The same report with sketched edges: values are never shuffled, only sketches and bins."""
    long = m.to_long(cohorts(t), FEATURES, Y)
    edges = m.fit_edges(reference(cohorts(t)), method="approx", group_bound=len(FEATURES))
    out = m.psi(long, edges, REF_YEAR, Y, group_bound=len(FEATURES))
    return out.select(F.col(Y).alias("year"), "feature", "n", r("missing_rate"), r("psi"))


@query("mon1_stored_sketches", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, Y)})
SELECT snapshot_year AS year, feature, COUNT(*) AS n, round(1 - COUNT(value) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_rate,
       COUNT(value) > 0 AS ranks_hold, COUNT(value) > 0 AS psi_holds
FROM long WHERE snapshot_year <> {REF_YEAR} GROUP BY ALL""")
def mon1_stored(t):
    """Every year against stored summaries; the bounds they state are held against counts of all rows."""
    long = m.to_long(stressed(t), FEATURES, Y)
    kept = materialize(sketches.summarize(long, Y), "summaries")
    report = sketches.stored_psi(kept, REF_YEAR, Y)
    out = sketches.audit(report, long, REF_YEAR, Y, group_bound=len(FEATURES))
    within = F.col("counted_psi").between(F.col("psi_low"), F.col("psi_high"))
    return out.select(F.col(Y).alias("year"), "feature", "n", r("missing_rate"),
                      F.coalesce(F.col("worst_rank") <= F.col("rank_error"), F.lit(False)).alias("ranks_hold"),
                      F.coalesce(within, F.lit(False)).alias("psi_holds"))
