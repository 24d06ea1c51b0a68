"""Roles the given tables play, each as a DataFrame and as the same SQL text.

``lineitem`` stands for annual cohorts, ``orders`` with customer, nation and region for
records with an area, ``documents`` with ``labels`` for a partly labelled binary outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
REF_YEAR = 1995
CLASSES = ["A", "N", "R"]
PROBS = [i / 10 for i in range(1, 10)]

SQL_HASH32 = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


def sql_hash(text: str) -> str:
    return SQL_HASH32.format(text)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, under its own name, so that two engines print the same digits."""
    return F.round(F.col(c), digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def six(c: Column) -> Column:
    """Six decimals in plain arithmetic, for columns of every row (``round`` goes through BigDecimal)."""
    return F.floor(c * 1e6 + 0.5) / 1e6


# ------------------------------------------------------------------ annual cohorts


def cohorts(t: Tables) -> DataFrame:
    """lineitem as annual cross-sections."""
    return t("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.year("l_shipdate").alias("snapshot_year"), "l_returnflag", "l_linestatus", *FEATURES,
    )


SQL_COHORTS = """cohorts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id,
         CAST(year(l_shipdate) AS INTEGER) AS snapshot_year, l_returnflag, l_linestatus,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""


def sql_long(source: str, features: list[str], keep: str) -> str:
    """UNION ALL form of an unpivot."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}" for f in features
    )


# ------------------------------------------------------------------ exact scores


def scored(t: Tables) -> DataFrame:
    """Three-class probabilities from a fixed softmax of quantity, discount and tax."""
    e = {"A": F.exp(F.col("l_quantity") * 0.02), "N": F.exp(F.col("l_discount") * 8.0), "R": F.exp(F.col("l_tax") * 10.0)}
    base = cohorts(t).select("record_id", "snapshot_year", "l_returnflag", "l_linestatus",
                             *[x.alias(f"e_{c}") for c, x in e.items()])
    total = F.col("e_A") + F.col("e_N") + F.col("e_R")
    p = base.select("record_id", "snapshot_year", "l_linestatus", F.col("l_returnflag").alias("label"),
                    *[six(F.col(f"e_{c}") / total).alias(f"p_{c}") for c in CLASSES])
    top = F.greatest(*[F.col(f"p_{c}") for c in CLASSES])
    return p.select(
        "record_id", "snapshot_year", "l_linestatus", "label",
        F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.col(f"p_{c}"))]).alias("probs"),
        F.when(F.col("p_A") == top, "A").when(F.col("p_N") == top, "N").otherwise("R").alias("predicted"),
    )


SQL_SCORED = SQL_COHORTS + """,
expd AS (
  SELECT record_id, snapshot_year, l_linestatus, l_returnflag AS label,
         exp(l_quantity * 0.02e0) AS ea, exp(l_discount * 8e0) AS en, exp(l_tax * 10e0) AS er
  FROM cohorts),
prob AS (
  SELECT record_id, snapshot_year, l_linestatus, label,
         floor(ea / (ea + en + er) * 1e6 + 0.5e0) / 1e6 AS pa, floor(en / (ea + en + er) * 1e6 + 0.5e0) / 1e6 AS pn,
         floor(er / (ea + en + er) * 1e6 + 0.5e0) / 1e6 AS pr
  FROM expd),
scored AS (
  SELECT *, CASE WHEN pa = greatest(pa, pn, pr) THEN 'A' WHEN pn = greatest(pa, pn, pr) THEN 'N' ELSE 'R' END AS predicted
  FROM prob)"""

SQL_OVR = SQL_SCORED + """,
ovr AS (
  SELECT snapshot_year, l_linestatus, label, 'A' AS class, pa AS score, CAST(label = 'A' AS INTEGER) AS y FROM scored
  UNION ALL SELECT snapshot_year, l_linestatus, label, 'N', pn, CAST(label = 'N' AS INTEGER) FROM scored
  UNION ALL SELECT snapshot_year, l_linestatus, label, 'R', pr, CAST(label = 'R' AS INTEGER) FROM scored)"""


# ------------------------------------------------------------------ area records


def area_records(t: Tables) -> DataFrame:
    """orders per customer, year and status, counted before the customer join.

    A customer with a third of all orders is a few rows by the time it is shuffled.
    """
    per_customer = t("orders").groupBy(
        "o_custkey", F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("status")
    ).agg(F.count("*").alias("n"))
    area = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("phm"), F.col("r_name").alias("moh"))
    by_nation = per_customer.join(area, "o_custkey").groupBy("c_nationkey", "period", "status").agg(
        F.sum("n").alias("n"))
    return by_nation.join(nation, "c_nationkey").select("moh", "phm", "period", "status", "n")


SQL_AREA = """area_records AS (
  SELECT r_name AS moh, n_name AS phm, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# ------------------------------------------------------------------ partly labelled text


SHAPE = ["word_ratio", "mean_word", "blank_share", "size_log"]


def shapes(t: Tables) -> DataFrame:
    """Four shape features over the whole text of every document."""
    words = F.split("text", " ")
    return t("documents").select(
        F.col("doc_id").alias("record_id"), "lang", "source", "n_chars",
        F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"),
    ).select(
        "record_id", "lang", "source",
        F.round(F.col("n_distinct") / F.col("n_words"), 6).alias("word_ratio"),
        F.round(F.col("n_chars") / F.col("n_words"), 6).alias("mean_word"),
        F.round((F.col("n_words") - 1) / F.col("n_chars"), 6).alias("blank_share"),
        F.round(F.ln(F.col("n_chars") + 1.0), 6).alias("size_log"),
    )


SQL_SHAPES = """words AS (
  SELECT doc_id, lang, source, n_chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words,
         CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) AS n_distinct
  FROM documents),
shapes AS (
  SELECT doc_id AS record_id, lang, source, round(n_distinct / n_words, 6) AS word_ratio,
         round(n_chars / n_words, 6) AS mean_word, round((n_words - 1) / n_chars, 6) AS blank_share,
         round(ln(n_chars + 1e0), 6) AS size_log
  FROM words)"""


def quality(t: Tables) -> DataFrame:
    """Fixed logistic score of word_ratio for every document, label where one exists."""
    p = 1 / (1 + F.exp(-(F.col("word_ratio") * 6.0 - 3.0)))
    s = shapes(t).withColumn("score", F.round(p, 6))
    labels = t("labels").select(F.col("doc_id").alias("record_id"), F.col("quality").cast("string").alias("label"), "toxic")
    return s.join(labels, "record_id", "left").select(
        "*", F.col("label").cast("int").alias("y"),
        F.create_map(F.lit("0"), 1 - F.col("score"), F.lit("1"), F.col("score")).alias("probs"),
        F.when(F.col("score") >= 0.5, "1").otherwise("0").alias("predicted"),
    )


SQL_QUALITY = SQL_SHAPES + """,
quality AS (
  SELECT s.*, CAST(l.quality AS VARCHAR) AS label, l.toxic, l.quality AS y,
         round(1 / (1 + exp(-(word_ratio * 6e0 - 3e0))), 6) AS score
  FROM shapes s LEFT JOIN labels l ON l.doc_id = s.record_id)"""

