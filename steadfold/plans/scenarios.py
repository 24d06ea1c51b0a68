"""Controlled stress testing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scenarios import WORDING, Scenario, apply_manifest, apply_scenario
from .registry import query
from .views import SQL_COHORTS, cohorts, sql_hash

Y = "snapshot_year"


def sql_u(scenario: str, column: str, rid: str = "record_id") -> str:
    text = f"'s1|{scenario}|{column}|' || {rid}"
    return f"({sql_hash(text)} / 4294967296e0)"


def summary(df):
    """Counts, gaps and means by year: what the monitors will see."""
    return df.groupBy(Y).agg(
        F.count("*").alias("n"), F.count("l_quantity").alias("n_quantity"), F.count("l_discount").alias("n_discount"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_discount"), 6).alias("mean_discount"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


def sql_summary(body: str) -> str:
    return f"""WITH {SQL_COHORTS}, x AS ({body})
SELECT snapshot_year, COUNT(*) AS n, COUNT(l_quantity) AS n_quantity, COUNT(l_discount) AS n_discount,
  round(AVG(l_quantity), 6) AS mean_quantity, round(AVG(l_discount), 6) AS mean_discount, round(AVG(l_extendedprice), 4) AS mean_price
FROM x GROUP BY ALL"""


MANIFEST = [
    Scenario("gaps", "data quality", "missing", ["l_quantity", "l_discount"], {"rate": 0.15}),
    Scenario("jitter", "data quality", "noise", ["l_quantity"], {"scale": 4.0}),
    Scenario("spikes", "data quality", "corrupt", ["l_extendedprice"], {"rate": 0.05, "factor": 10.0}),
    Scenario("mix", "covariate", "composition", params={"stratum": "l_linestatus", "keep": {"O": 0.4, "F": 0.9}}),
    Scenario("surge", "prevalence", "prevalence", params={"label": "l_returnflag", "copies": {"A": 2.5, "N": 0.5}}),
    Scenario("lost", "operational", "unavailable", ["l_quantity"]),
    Scenario("unit", "operational", "unit_missing", ["l_discount"], {"unit_column": "l_linestatus", "unit": "F", "rate": 0.6}),
    Scenario("coarse", "operational", "procedure", ["l_quantity"], {"step": 5.0}),
]
BY_NAME = {s.name: s for s in MANIFEST}
CONCEPT = Scenario("flip", "concept", "concept", params={
    "label": "l_returnflag", "remap": {"N": "A"}, "region": "l_quantity > 30"}, tier="stretch")

COLS = "snapshot_year, record_id, l_returnflag, l_linestatus"
SQL_BODY = {
    "gaps": f"""SELECT {COLS}, CASE WHEN {sql_u('gaps', 'l_quantity')} >= 0.15e0 THEN l_quantity END AS l_quantity,
      CASE WHEN {sql_u('gaps', 'l_discount')} >= 0.15e0 THEN l_discount END AS l_discount, l_extendedprice FROM cohorts""",
    "jitter": f"SELECT {COLS}, l_quantity + 4e0 * ({sql_u('jitter', 'l_quantity')} - 0.5e0) AS l_quantity, l_discount, l_extendedprice FROM cohorts",
    "spikes": f"""SELECT {COLS}, l_quantity, l_discount,
      CASE WHEN {sql_u('spikes', 'l_extendedprice')} < 0.05e0 THEN l_extendedprice * 10e0 ELSE l_extendedprice END AS l_extendedprice FROM cohorts""",
    "mix": f"""SELECT {COLS}, l_quantity, l_discount, l_extendedprice FROM cohorts
      WHERE {sql_u('mix', 'keep')} < CASE l_linestatus WHEN 'O' THEN 0.4e0 WHEN 'F' THEN 0.9e0 ELSE 1e0 END""",
    "surge": f"""SELECT snapshot_year, CASE WHEN k = 1 THEN record_id ELSE record_id || '#' || k END AS record_id, l_returnflag, l_linestatus,
        l_quantity, l_discount, l_extendedprice
      FROM (SELECT *, unnest(range(1, 1 + CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT))) AS k
            FROM (SELECT *, {sql_u('surge', 'copies')} AS u, CASE l_returnflag WHEN 'A' THEN 2.5e0 WHEN 'N' THEN 0.5e0 ELSE 1e0 END AS rate FROM cohorts))""",
    "lost": f"SELECT {COLS}, CAST(NULL AS DOUBLE) AS l_quantity, l_discount, l_extendedprice FROM cohorts",
    "unit": f"""SELECT {COLS}, l_quantity, CASE WHEN NOT (l_linestatus = 'F' AND {sql_u('unit', 'l_discount')} < 0.6e0) THEN l_discount END AS l_discount,
      l_extendedprice FROM cohorts""",
    "coarse": f"SELECT {COLS}, floor(l_quantity / 5e0 + 0.5e0) * 5e0 AS l_quantity, l_discount, l_extendedprice FROM cohorts",
}


def _register(number: int, name: str, label: str) -> None:
    @query(f"inj{number}_{label}", sql_summary(SQL_BODY[name]))
    def run(t):
        return summary(apply_scenario(cohorts(t), BY_NAME[name], "record_id"))


for _n, (_name, _label) in enumerate([
        ("gaps", "missingness"), ("jitter", "noise"), ("spikes", "corrupted"), ("mix", "composition"),
        ("surge", "prevalence"), ("lost", "unavailable"), ("unit", "unit_missing"), ("coarse", "procedure")], start=1):
    _register(_n, _name, _label)


@query("inj5_class_counts", f"""
WITH {SQL_COHORTS}, x AS ({SQL_BODY['surge']})
SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT record_id) AS n_ids, CAST(SUM(CASE WHEN record_id LIKE '%#%' THEN 1 ELSE 0 END) AS BIGINT) AS n_derived
FROM x GROUP BY ALL""")
def inj5_classes(t):
    return apply_scenario(cohorts(t), BY_NAME["surge"], "record_id").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"),
        F.count_if(F.col("record_id").contains("#")).alias("n_derived"))


@query("inj9_concept_change", f"""
WITH {SQL_COHORTS}
SELECT snapshot_year, CASE WHEN l_quantity > 30 AND l_returnflag = 'N' THEN 'A' ELSE l_returnflag END AS l_returnflag, 'stretch' AS tier, COUNT(*) AS n
FROM cohorts GROUP BY ALL""")
def inj9(t):
    return apply_scenario(cohorts(t), CONCEPT, "record_id").groupBy(Y, "l_returnflag").agg(
        F.count("*").alias("n")).withColumn("tier", F.lit(CONCEPT.tier))


SQL_ALL = " UNION ALL ".join(
    [f"SELECT 'none' AS scenario, 'baseline' AS category, {COLS}, l_quantity, l_discount, l_extendedprice FROM cohorts"]
    + [f"SELECT '{s.name}', '{s.category}', {COLS}, l_quantity, l_discount, l_extendedprice FROM ({SQL_BODY[s.name]})" for s in MANIFEST])


@query("inj10_manifest", f"""
WITH {SQL_COHORTS}, x AS ({SQL_ALL})
SELECT scenario, category, 'core' AS tier, '{WORDING}' AS wording, l_returnflag, COUNT(*) AS n, COUNT(l_quantity) AS n_quantity,
  COUNT(l_discount) AS n_discount, round(AVG(l_quantity), 6) AS mean_quantity, round(AVG(l_extendedprice), 4) AS mean_price
FROM x GROUP BY ALL""")
def inj10(t):
    return apply_manifest(cohorts(t), MANIFEST, "record_id").groupBy("scenario", "category", "tier", "wording", "l_returnflag").agg(
        F.count("*").alias("n"), F.count("l_quantity").alias("n_quantity"), F.count("l_discount").alias("n_discount"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))

