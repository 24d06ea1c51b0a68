"""Continuous shift monitor over event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edge_rank
from ..operators.shift import _hist_psi
from ..session import join_bounded


def monitor_windows(stream: DataFrame, edges: DataFrame, ts: str, width: str, delay: str,
                    n_bins: int = 10, by: Sequence[str] = (), group_bound: int | None = None) -> DataFrame:
    """Histogram of every closed tumbling window.

    ``stream`` is long: ``(ts, feature, value, by)``.  Only bin counts are kept as state, so
    the state grows with windows x features x bins and not with the rows.  ``ts`` must be a
    TIMESTAMP (a watermark cannot use TIMESTAMP_NTZ).
    """
    groups = ["feature", *by]
    binned = join_bounded(stream, edges.select(*groups, "edges"), groups, "left", rows=group_bound).withColumn(
        "__bin", F.when(F.col("value").isNull(), -1).when(F.col("edges").isNull(), -2)
        .otherwise(edge_rank("value", "edges", n_bins - 1)))
    return (
        binned.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("window"), *groups)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("__bin") == -1).alias("n_missing"),
            F.count_if(F.col("__bin") >= 0).alias("n_binned"),
            *[F.count_if(F.col("__bin") == i).alias(f"h{i}") for i in range(n_bins)],
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                *groups, "n_rows", "n_missing", "n_binned", *[f"h{i}" for i in range(n_bins)])
    )


def run_monitor(windows: DataFrame, baseline: DataFrame, out: str, checkpoint: str,
                n_bins: int = 10, eps: float = 1e-4, by: Sequence[str] = (),
                trigger: dict | None = None):
    """Start the query: PSI of each closed window against the static baseline histogram.

    ``baseline`` is read in every micro-batch: pass a stored table, not a query over the raw
    reference rows.  A micro-batch owns the folder of its batch id, so a replay after a failure overwrites
    its own output and nothing is counted twice.  Returns the StreamingQuery.
    """
    groups = ["feature", *by]
    base = baseline.select(*groups, F.col("n_binned").alias("r_n_binned"), *[F.col(f"h{i}").alias(f"r_h{i}") for i in range(n_bins)])

    def write(batch: DataFrame, batch_id: int) -> None:
        join_bounded(batch, base, groups, "left").select(
            "window_start", "window_end", *groups, "n_rows", "n_missing", _hist_psi(n_bins, "r_", "", eps).alias("psi"),
        ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        windows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def late_rows(monitored: DataFrame, source: DataFrame, ts: str, width: str, by: Sequence[str] = (),
              delay: str = "0 seconds") -> DataFrame:
    """Rows that came after their window had closed, per window: source count minus counted.

    ``source`` is the batch view of everything that arrived, ``delay`` the monitor's.  Every closed
    window is reported, also one whose rows of a group were all late (``n_rows`` is 0 then).
    """
    groups = ["feature", *by]
    arrived = source.groupBy(F.window(ts, width).alias("w"), *groups).agg(F.count("*").alias("n_arrived"))
    last = source.agg(F.max(ts)).scalar()
    arrived = arrived.where(F.col("w.end") <= last - F.expr(f"INTERVAL {delay}")).select(
        F.col("w.start").alias("window_start"), *groups, "n_arrived")
    counted = F.coalesce("n_rows", F.lit(0))
    return join_bounded(arrived, monitored.select("window_start", *groups, "n_rows"), ["window_start", *groups], "left").select(
        "window_start", *groups, "n_arrived", counted.alias("n_rows"), (F.col("n_arrived") - counted).alias("n_late"))
