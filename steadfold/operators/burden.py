"""Area burden, its forecast and the resources it implies.  No trained model involved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..session import join_bounded


def burden(records: DataFrame, areas: Sequence[str], period: str, status: str,
           weight: str | None = None) -> DataFrame:
    """Cases, denominator and prevalence by area x period x status.

    ``weight`` names a count column when the records are already pre-aggregated.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = records.groupBy(*areas, period, status).agg(n.alias("cases"))
    w = Window.partitionBy(*areas, period)
    return counts.withColumn("denominator", F.sum("cases").over(w)).withColumn(
        "prevalence", safe_ratio(F.col("cases"), F.col("denominator")))


def burden_rollup(burden_table: DataFrame, area_levels: Sequence[str], period: str, status: str) -> DataFrame:
    """Roll up from the finest area to all areas (first level is the coarsest).

    Period and status stay, the areas are rolled up.  ``level`` is the grouping id: 0 for
    the finest area, all bits set for the grand total.
    """
    levels, keys = list(area_levels), [period, status]
    sets = [[*levels[:depth], *keys] for depth in range(len(levels), -1, -1)]
    gid = F.shiftright(F.grouping_id(), len(keys)).cast("int")
    return burden_table.groupingSets(sets, *levels, *keys).agg(F.sum("cases").alias("cases"), gid.alias("level"))


def partial_last(records: DataFrame, date: str) -> DataFrame:
    """One row with ``partial_period``: the last year, if the records stop before its end, else NULL.

    They stop before it when the days from the last record to the next year are more than at the end
    of any earlier year, and more than the widest step between two days inside the last year (one
    day at least), so that neither sparse records nor an old gap decide.  The answer is one for the
    whole table: where a delivery ends is no property of an area.  Days are distinct first, so the
    windows hold a calendar.  Without any date the result is NULL.
    """
    days = records.select(F.to_date(date).alias("d")).where(F.col("d").isNotNull()).distinct().withColumn("y", F.year("d"))
    days = days.withColumn("step", F.datediff("d", F.lag("d").over(Window.partitionBy("y").orderBy("d"))))
    tails = days.groupBy("y").agg(
        F.datediff(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)), F.max("d")).alias("tail"), F.max("step").alias("step"))
    last = F.max(F.struct("y", "tail", "step"))
    ends = tails.agg(last.alias("last"), F.sort_array(F.collect_list(F.struct("y", "tail"))).alias("all"))
    earlier = F.array_max(F.transform(F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0))), lambda t: t["tail"]))
    widest = F.greatest(F.lit(1), earlier, F.col("last.step"))
    return ends.select(F.when(F.col("last.tail") > widest, F.col("last.y")).alias("partial_period"))


def forecast(series: DataFrame, keys: Sequence[str], period: str, value: str, horizon: int = 1,
             min_periods: int = 3) -> DataFrame:
    """Next periods per area by last value and by linear trend.

    ``n_periods`` travels with every forecast; the trend is NULL under ``min_periods``
    points, and a count can not fall below zero.
    """
    fitted = series.groupBy(*keys).agg(
        F.count("*").alias("n_periods"),
        F.max(period).alias("last_period"),
        F.max_by(F.col(value).cast("double"), period).alias("last_value"),
        F.regr_slope(F.col(value).cast("double"), F.col(period)).alias("slope"),
        F.avg(F.col(value).cast("double")).alias("__my"),
        F.avg(period).alias("__mx"),
    )
    ahead = fitted.withColumn("h", F.explode(F.array(*[F.lit(h) for h in range(1, horizon + 1)])))
    target = F.col("last_period") + F.col("h")
    trend = F.col("__my") + F.col("slope") * (target - F.col("__mx"))
    return ahead.select(
        *keys, "n_periods", target.alias(period), "last_value",
        F.when(F.col("n_periods") >= min_periods, F.greatest(trend, F.lit(0.0))).alias("trend_value"),
    )


def rising(series: DataFrame, keys: Sequence[str], period: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Change to the previous period and the rank of the areas within each period (and ``within``)."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    by_period = Window.partitionBy(period, *within).orderBy(F.col("change").desc_nulls_last())
    return series.withColumn("change", change).where(F.col("change").isNotNull()).withColumn(
        "rank", F.rank().over(by_period))


def resource_demand(forecasts: DataFrame, rates: DataFrame, category: str, cases: str,
                    n_rates: int | None = None) -> DataFrame:
    """Forecast cases times the per-case rate of every resource the user listed."""
    r = rates.withColumnRenamed("category", category) if category != "category" else rates
    return join_bounded(forecasts, r, [category], rows=n_rates).withColumn(
        "demand", F.col(cases) * F.col("per_case"))


def holdout_error(series: DataFrame, keys: Sequence[str], period: str, value: str,
                  min_periods: int = 3) -> DataFrame:
    """Forecast of each area's last period from the earlier ones, with absolute errors.

    Areas without a period right before the last one stay in the result with NULL errors.
    """
    last = series.groupBy(*keys).agg(F.max(period).alias("__last"))
    marked = join_bounded(series, last, keys)
    earlier = marked.where(F.col(period) < F.col("__last")).drop("__last")
    actual = marked.where(F.col(period) == F.col("__last")).select(*keys, period, F.col(value).alias("actual"))
    predicted = forecast(earlier, keys, period, value, 1, min_periods)
    return join_bounded(actual, predicted, [*keys, period], "left").withColumns({
        "last_value_error": F.abs(F.col("last_value") - F.col("actual")),
        "trend_error": F.abs(F.col("trend_value") - F.col("actual")),
    })
