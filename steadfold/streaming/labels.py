"""Outcome labels that arrive after the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_outcomes(preds: DataFrame, outcomes: DataFrame, horizon: str, delay: str,
                   record_id: str = "record_id") -> DataFrame:
    """Stream-stream left outer join: each prediction with its label, or NULL after the horizon.

    Watermarks on both sides and the time range bound the state; an unlabelled prediction is
    emitted once no label within ``horizon`` can still arrive.
    """
    p = preds.withWatermark("scored_at", delay)
    o = outcomes.withColumnRenamed(record_id, "__rid").withWatermark("label_ts", delay)
    cond = (
        (F.col(record_id) == F.col("__rid"))
        & (F.col("label_ts") >= F.col("scored_at"))
        & (F.col("label_ts") <= F.col("scored_at") + F.expr(f"INTERVAL {horizon}"))
    )
    return p.join(o, cond, "leftOuter").drop("__rid")
