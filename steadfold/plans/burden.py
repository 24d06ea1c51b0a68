"""Area burden queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import burden as m
from ..operators.ingest import with_context
from ..session import join_bounded, literal_table
from .ingest import SQL_CONTEXT, context
from .registry import query
from .views import SQL_AREA, area_records, r

AREAS = ["moh", "phm"]
SQL_BURDEN = SQL_AREA + """,
c AS (SELECT moh, phm, period, status, COUNT(*) AS cases FROM area_records GROUP BY ALL),
burden AS (SELECT *, CAST(SUM(cases) OVER (PARTITION BY moh, phm, period) AS BIGINT) AS denominator FROM c)"""


def table(t):
    return m.burden(area_records(t), AREAS, "period", "status", "n")


KEYS = [*AREAS, "status", "partial_period"]


def series(t):
    """Every status and period; ``partial`` marks a last period that the records do not fill."""
    last = m.partial_last(t("orders"), "o_orderdate").withColumn("__one", F.lit(1))
    return join_bounded(table(t).withColumn("__one", F.lit(1)), last, ["__one"], rows=1).drop("__one").withColumn(
        "partial", F.coalesce(F.col("period") == F.col("partial_period"), F.lit(False)))


def complete(t):
    """What forecasts are fitted to; ``partial_period`` names what is left out, if anything."""
    return series(t).where(~F.col("partial"))


SQL_SERIES = SQL_BURDEN + """,
days AS (SELECT d, year(d) AS y, d - lag(d) OVER (PARTITION BY year(d) ORDER BY d) AS step FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
tails AS (SELECT y, make_date(y + 1, 1, 1) - MAX(d) AS tail, MAX(step) AS step FROM days GROUP BY y),
lastp AS (SELECT CASE WHEN max_by(tail, y) > greatest(1, MAX(tail) FILTER (y < ly), max_by(step, y)) THEN CAST(MAX(y) AS INTEGER) END AS partial_period
  FROM (SELECT *, MAX(y) OVER () AS ly FROM tails)),
series AS (SELECT b.*, partial_period, COALESCE(period = partial_period, false) AS partial FROM burden b CROSS JOIN lastp),
whole AS (SELECT *, MAX(period) OVER (PARTITION BY moh, phm, status) AS lp FROM series WHERE NOT partial)"""


@query("fc1_burden", f"""
WITH {SQL_BURDEN} SELECT moh, phm, period, status, cases, denominator, round(cases / CAST(denominator AS DOUBLE), 6) AS prevalence FROM burden""")
def fc1(t):
    return table(t).withColumn("prevalence", r("prevalence"))


@query("fc2_area_rollup", f"""
WITH {SQL_BURDEN} SELECT moh, phm, period, status, CAST(SUM(cases) AS BIGINT) AS cases, CAST(GROUPING(moh, phm) AS INTEGER) AS level
FROM burden GROUP BY GROUPING SETS ((moh, phm, period, status), (moh, period, status), (period, status))""")
def fc2(t):
    return m.burden_rollup(table(t), AREAS, "period", "status")


SQL_FORECAST = """
fit AS (SELECT moh, phm, status, partial_period, COUNT(*) AS n_periods, MAX(period) AS last_period, CAST(max_by(cases, period) AS DOUBLE) AS last_value,
          regr_slope(cases, period) AS b, AVG(cases) AS my, AVG(period) AS mx FROM {src} GROUP BY ALL),
fc AS (SELECT moh, phm, status, partial_period, n_periods, CAST(last_period + h AS INTEGER) AS period, last_value,
         CASE WHEN n_periods >= 3 THEN greatest(my + b * (last_period + h - mx), 0e0) END AS trend_value
       FROM fit CROSS JOIN (SELECT unnest([{h}]) AS h))"""


@query("fc3_forecast", f"""
WITH {SQL_SERIES}, {SQL_FORECAST.format(src="whole", h="1, 2")}
SELECT moh, phm, status, partial_period, n_periods, period, last_value, round(trend_value, 4) AS trend_value FROM fc""")
def fc3(t):
    return m.forecast(complete(t), KEYS, "period", "cases", horizon=2).withColumn("trend_value", r("trend_value", 4))


@query("fc4_rising_areas", f"""
WITH {SQL_SERIES}, d AS (SELECT *, cases - lag(cases) OVER (PARTITION BY moh, phm, status ORDER BY period) AS change FROM series)
SELECT moh, phm, status, period, cases, CAST(change AS BIGINT) AS change, partial,
  CAST(rank() OVER (PARTITION BY period, status ORDER BY change DESC) AS INTEGER) AS rank FROM d WHERE change IS NOT NULL""")
def fc4(t):
    return m.rising(series(t), [*AREAS, "status"], "period", "cases", ["status"]).select(
        "moh", "phm", "status", "period", "cases", "change", "rank", "partial")


RATES = [("supplement packs", "F", 3.5), ("clinic hours", "F", 0.25), ("clinic hours", "O", 0.1)]


@query("fc5_resource_demand", f"""
WITH {SQL_SERIES}, {SQL_FORECAST.format(src="whole", h="1")},
rates(resource, category, per_case) AS (VALUES {", ".join(f"('{a}', '{b}', {c}e0)" for a, b, c in RATES)})
SELECT moh, phm, status, partial_period, period, resource, round(trend_value * per_case, 4) AS demand FROM fc JOIN rates ON category = status""")
def fc5(t):
    rates = literal_table(t.spark, RATES, "resource string, category string, per_case double")
    ahead = m.forecast(complete(t), KEYS, "period", "cases")
    return m.resource_demand(ahead, rates, "status", "trend_value", n_rates=len(RATES)).select(
        *KEYS, "period", "resource", r("demand", 4))


@query("fc6_context_lag", f"""
WITH {SQL_SERIES}, {SQL_CONTEXT}
SELECT s.moh, s.phm, s.status, s.period, s.cases, s.partial, c.cpi AS cpi_lag1, c.food_price AS food_price_lag1
FROM series s LEFT JOIN context c ON c.period = s.period - 1""")
def fc6(t):
    return with_context(series(t).select("moh", "phm", "status", "period", "cases", "partial"), context(t), ["period"], lag_years=1,
                        year="period", n_context=100)


@query("fc7_holdout_error", f"""
WITH {SQL_SERIES}, earlier AS (SELECT * FROM whole WHERE period < lp), {SQL_FORECAST.format(src="earlier", h="1")}
SELECT a.moh, a.phm, a.status, a.partial_period, a.period, a.cases AS actual, n_periods, last_value, round(trend_value, 4) AS trend_value,
  abs(last_value - a.cases) AS last_value_error, round(abs(trend_value - a.cases), 4) AS trend_error
FROM (SELECT * FROM whole WHERE period = lp) a LEFT JOIN fc f ON f.moh = a.moh AND f.phm = a.phm AND f.status = a.status AND f.period = a.period""")
def fc7(t):
    return m.holdout_error(complete(t), KEYS, "period", "cases").select(
        *KEYS, "period", "actual", "n_periods", "last_value", r("trend_value", 4), "last_value_error", r("trend_error", 4))
