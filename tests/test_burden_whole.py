"""Forecasts of every status and period, with a partial last period found from the data."""

from __future__ import annotations

import datetime

import pytest

from steadfold import plans
from steadfold.operators import burden


def test_every_order_counts(spark, sf_dir):
    rows = plans.queries()["fc6_context_lag"](spark, sf_dir).collect()
    assert sum(r["cases"] for r in rows) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert {r["status"] for r in rows} == {"F", "O", "P"}
    assert {r["period"] for r in rows if r["partial"]} == {2001}


@pytest.mark.parametrize("last, partial", [("2002-12-31", None), ("2002-12-25", None), ("2002-08-01", 2002), ("2003-01-04", 2003)])
def test_partial_last_period(spark, last, partial):
    end = datetime.date.fromisoformat(last)
    days = {end - datetime.timedelta(days=7 * i) for i in range(120)}
    assert burden.partial_last(spark.createDataFrame([(d,) for d in days], "d date"), "d").first()[0] == partial


@pytest.mark.parametrize("days, partial", [
    (["2000-01-01", "2000-08-01", "2001-06-10"], 2001), (["2000-01-01", "2000-06-01", "2001-08-01"], None), (["2001-12-31"], None), ([], None)])
def test_old_gaps_do_not_hide_a_partial_period(spark, days, partial):
    rows = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in days] + [(None,)], "d date")
    assert burden.partial_last(rows, "d").first()[0] == partial
