"""Ingestion, curation and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_mille
from ..operators import ingest as m
from ..operators.burden import burden
from ..session import scratch_path
from ..sources import SnapshotSource, align, append_report, publish, read_published, read_report, read_snapshots
from .registry import query
from .shift import SQL_STRESSED, stressed
from .views import FEATURES, SQL_AREA, area_records, r, sql_hash, sql_long

Y = "snapshot_year"


def snapshots(t):
    """A narrow snapshot (supplier) and a richer one (customer) in one vocabulary."""
    return read_snapshots(t.spark, [
        SnapshotSource(2024, t.path("supplier"), "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
                       rename={"s_suppkey": "record_id", "s_name": "name", "s_nationkey": "area", "s_acctbal": "balance"}),
        SnapshotSource(2025, t.path("customer"),
                       "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
                       rename={"c_custkey": "record_id", "c_name": "name", "c_nationkey": "area", "c_acctbal": "balance",
                               "c_mktsegment": "segment"}),
    ])


SQL_SNAPSHOTS = """snaps AS (
  SELECT CAST(2024 AS INTEGER) AS snapshot_year, s_suppkey AS record_id, s_name AS name, s_nationkey AS area, s_acctbal AS balance,
    CAST(NULL AS VARCHAR) AS segment FROM supplier
  UNION ALL SELECT CAST(2025 AS INTEGER), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"""


@query("ing1_read_snapshots", f"WITH {SQL_SNAPSHOTS} SELECT snapshot_year, record_id, name, area, balance FROM snaps")
def ing1(t):
    narrow, rich = snapshots(t)
    return narrow.unionByName(rich.drop("segment"))


@query("ing2_align_schemas", f"WITH {SQL_SNAPSHOTS} SELECT * FROM snaps")
def ing2(t):
    return align(snapshots(t))


def raw_customers(t):
    """Customers as digitized text: padded numbers, some unreadable, some blank."""
    h = hash_mille("s1", "raw", F.col("c_custkey"))
    return t("customer").select(
        "c_custkey", "c_mktsegment",
        F.when(h < 40, "n/a").when(h < 80, "  ").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" "))).alias("balance"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")).alias("area"),
    )


def curated(t):
    rules = {"balance below zero": F.col("balance") >= 0, "area out of domain": F.col("area").between(0, 22)}
    return m.curate(raw_customers(t), {"balance": "double", "area": "int"}, rules)


SQL_RAW = f"""raw AS (
  SELECT c_custkey, c_mktsegment, {sql_hash("'s1|raw|' || c_custkey")} % 1000 AS h, c_acctbal, c_nationkey FROM customer),
judged AS (SELECT *, h < 40 AS unreadable, h >= 80 AND c_acctbal < 0 AS below, c_nationkey NOT BETWEEN 0 AND 22 AS outside FROM raw)"""


@query("ing3_curate_clean", f"""
WITH {SQL_RAW} SELECT c_custkey, c_mktsegment, CASE WHEN h >= 80 THEN c_acctbal END AS balance, c_nationkey AS area
FROM judged WHERE NOT unreadable AND NOT below AND NOT outside""")
def ing3_clean(t):
    return curated(t)[0]


@query("ing3_curate_rejects", f"""
WITH {SQL_RAW} SELECT c_custkey, c_mktsegment, CASE WHEN unreadable THEN 'n/a' WHEN h < 80 THEN NULL ELSE CAST(c_acctbal AS VARCHAR) END AS balance,
  CAST(c_nationkey AS VARCHAR) AS area,
  concat_ws('; ', CASE WHEN unreadable THEN 'balance: not double' END, CASE WHEN below THEN 'balance below zero' END,
            CASE WHEN outside THEN 'area out of domain' END) AS failed_rules
FROM judged WHERE unreadable OR below OR outside""")
def ing3_rejects(t):
    return curated(t)[1].withColumn("failed_rules", F.array_join("failed_rules", "; "))


@query("ing3_published", f"""
WITH {SQL_RAW} SELECT 'r1' AS run_id, 'processed' AS folder, c_mktsegment, COUNT(*) AS n, COUNT(*) - COUNT(CASE WHEN h >= 80 THEN 1 END) AS n_absent
FROM judged WHERE NOT unreadable AND NOT below AND NOT outside GROUP BY ALL
UNION ALL SELECT 'r1', 'quarantine', c_mktsegment, COUNT(*), COUNT(CASE WHEN h BETWEEN 40 AND 79 THEN 1 END)
FROM judged WHERE unreadable OR below OR outside GROUP BY ALL""")
def ing3_published(t):
    """Processed and quarantined rows in folders by segment, published together and read through the manifest."""
    root = scratch_path(t.spark, "curated")
    clean, rejects = curated(t)
    folders = {"processed": ["c_mktsegment"], "quarantine": ["c_mktsegment"]}
    publish(t.spark, {"processed": clean.limit(0), "quarantine": rejects.limit(0)}, root, "r1", folders)
    publish(t.spark, {"processed": clean, "quarantine": rejects}, root, "r1", folders)  # takes the place of the first attempt
    tables = [read_published(t.spark, root, name).select("run_id", F.lit(name).alias("folder"), "c_mktsegment", F.col("balance").cast("string").alias("b"))
              for name in folders]
    return tables[0].unionByName(tables[1]).groupBy("run_id", "folder", "c_mktsegment").agg(
        F.count("*").alias("n"), (F.count("*") - F.count("b")).alias("n_absent"))


@query("ing4_age_from_dates", """
WITH pair AS (SELECT CAST(o_orderdate AS DATE) AS b, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
mon AS (SELECT (year(d) - year(b)) * 12 + month(d) - month(b)
   - CASE WHEN day(d) < day(b) AND NOT (d = last_day(d) AND b = last_day(b)) THEN 1 ELSE 0 END AS m FROM pair)
SELECT CAST(CASE WHEN m >= 0 THEN m END AS INTEGER) AS age_months, COUNT(*) AS n FROM mon GROUP BY ALL""")
def ing4(t):
    pair = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate").join(
        t("orders").select(F.col("o_orderkey").alias("k"), "o_orderdate"), "k")
    return m.with_age(pair, "o_orderdate", "l_shipdate").groupBy("age_months").agg(F.count("*").alias("n"))


SQL_COVERAGE = f"""cov AS (SELECT snapshot_year, feature, COUNT(*) AS n_rows, COUNT(value) AS n_present,
   COUNT(value) / CAST(COUNT(*) AS DOUBLE) AS coverage FROM long GROUP BY ALL)"""


@query("ing5_coverage", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, "snapshot_year, l_linestatus")})
SELECT snapshot_year, l_linestatus, feature, COUNT(*) AS n_rows, COUNT(value) AS n_present,
  round(COUNT(value) / CAST(COUNT(*) AS DOUBLE), 6) AS coverage FROM long GROUP BY ALL""")
def ing5(t):
    return m.coverage(stressed(t), FEATURES, [Y, "l_linestatus"]).withColumn("coverage", r("coverage"))


@query("ing5_feature_overlap", f"""
WITH {SQL_STRESSED}, long AS ({sql_long("stressed", FEATURES, Y)}), {SQL_COVERAGE},
a AS (SELECT feature FROM cov WHERE snapshot_year = 1999 AND coverage >= 0.5e0),
b AS (SELECT feature FROM cov WHERE snapshot_year = 2000 AND coverage >= 0.5e0)
SELECT feature, 'common' AS membership FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT feature, 'only 1999' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT feature, 'only 2000' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def ing5_overlap(t):
    return m.feature_overlap(m.coverage(stressed(t), FEATURES), 1999, 2000)


@query("ing5_distinct_areas", f"""
WITH {SQL_AREA} SELECT period, COUNT(DISTINCT phm) AS n_phm, COUNT(DISTINCT moh) AS n_moh FROM area_records GROUP BY ALL""")
def ing5_areas(t):
    return m.distinct_areas(area_records(t), ["phm", "moh"], ["period"])


@query("ing6_linkage", """
SELECT n_years, COUNT(*) AS n_ids FROM (SELECT o_custkey, COUNT(DISTINCT year(o_orderdate)) AS n_years FROM orders GROUP BY ALL) GROUP BY ALL""")
def ing6(t):
    return m.linkage(t("orders").select("o_custkey", F.year("o_orderdate").alias(Y)), "o_custkey")


def context(t):
    """Yearly context: mean discount and tax of the year's lines."""
    return t("lineitem").groupBy(F.year("l_shipdate").alias("period")).agg(
        F.round(F.avg("l_discount"), 8).alias("cpi"), F.round(F.avg("l_tax"), 8).alias("food_price"))


SQL_CONTEXT = """context AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS period, round(AVG(l_discount), 8) AS cpi,
  round(AVG(l_tax), 8) AS food_price FROM lineitem GROUP BY ALL)"""


@query("ing7_context_join", f"""
WITH {SQL_AREA}, {SQL_CONTEXT}
SELECT moh, phm, period, status, COUNT(*) AS n, ANY_VALUE(cpi) AS cpi, ANY_VALUE(food_price) AS food_price
FROM area_records LEFT JOIN context USING (period) GROUP BY ALL""")
def ing7(t):
    return m.with_context(area_records(t), context(t), ["period"], n_context=100)


@query("ing8_effective_n", f"""
WITH {SQL_CONTEXT}, rec AS (SELECT o_orderstatus AS status, cpi, food_price FROM orders LEFT JOIN context ON period = year(o_orderdate)),
long AS ({sql_long("rec", ["cpi", "food_price"], "status")})
SELECT status, feature, COUNT(*) AS n_rows, COUNT(DISTINCT value) AS n_distinct_context FROM long GROUP BY ALL""")
def ing8(t):
    rec = t("orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("period"))
    joined = m.with_context(rec, context(t), ["period"], n_context=100)
    return m.effective_n(joined, ["cpi", "food_price"], ["status"])


WEIGHTS = {"reference": 600, "adapt": 250, "verify": 150}


@query("ing9_frozen_split", f"""
WITH h AS (SELECT o_orderkey, {sql_hash("'frozen|' || o_orderkey")} % 1000 AS h FROM orders)
SELECT o_orderkey, CASE WHEN h < 600 THEN 'reference' WHEN h < 850 THEN 'adapt' ELSE 'verify' END AS split FROM h""")
def ing9(t):
    return m.assign_split(t("orders").select("o_orderkey"), "o_orderkey", WEIGHTS, "frozen")


@query("ing10_report_sink", f"""
WITH {SQL_AREA}, c AS (SELECT moh, phm, period, status, COUNT(*) AS cases FROM area_records GROUP BY ALL)
SELECT moh, phm, period, status, cases, CAST(SUM(cases) OVER (PARTITION BY moh, phm, period) AS BIGINT) AS denominator,
  round(cases / CAST(SUM(cases) OVER (PARTITION BY moh, phm, period) AS DOUBLE), 6) AS prevalence, 'r1' AS run_id FROM c""")
def ing10(t):
    root = scratch_path(t.spark, "reports")
    table = burden(area_records(t), ["moh", "phm"], "period", "status", "n").withColumn("prevalence", r("prevalence"))
    append_report(table, root, "burden", "r1")
    append_report(table, root, "burden", "r1")  # a repeated run replaces itself
    return read_report(t.spark, root, "burden")
