"""Structured Streaming queries: a finite source is read to its end and the result table returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_mille
from ..operators import shift
from ..session import materialize, scratch_path
from ..streaming import late_rows, match_outcomes, monitor_windows, run_monitor
from .registry import Tables, query
from .shift import EDGE_LIST
from .views import r, sql_hash

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
MONITORED = "window_start TIMESTAMP, window_end TIMESTAMP, feature STRING, event_type STRING, n_rows BIGINT, n_missing BIGINT, psi DOUBLE"
MATCHED = "record_id BIGINT, scored_at TIMESTAMP, label_ts TIMESTAMP, label STRING"
WIDTH, DELAY = "1 day", "2 hours"


def instant(ts: Column) -> Column:
    """A zone-less UTC time as TIMESTAMP, whatever the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def utc_text(ts: Column) -> Column:
    """Text of a TIMESTAMP in UTC."""
    local = ts.cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local), "yyyy-MM-dd HH:mm:ss")


def stream(t: Tables) -> DataFrame:
    """The table as a stream; the pattern takes a single file as well as a folder of part files."""
    return t.spark.readStream.schema(EVENTS).parquet(f"{t.dir}/events.parque[t]")


def monitored(df: DataFrame) -> DataFrame:
    return df.select(instant(F.col("ts")).alias("ts"), "event_type", F.lit("value").alias("feature"), "value")


def _monitor(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(monitored windows, batch view of the same source)."""
    batch = monitored(t("events"))
    base = batch.where(F.col("ts") < instant(F.lit("2024-01-11").cast("timestamp_ntz")))
    groups = ["feature", "event_type"]
    edges = materialize(shift.fit_edges(base, groups), "edges")
    hist = materialize(shift.histogram(base, edges, groups, groups), "baseline")
    windows = monitor_windows(monitored(stream(t)), edges, "ts", WIDTH, DELAY, by=["event_type"])
    out = scratch_path(t.spark, "monitor")
    q = run_monitor(windows, hist, out, scratch_path(t.spark, "monitor-state"), by=["event_type"])
    q.awaitTermination()
    # an empty source has a result, too
    t.spark.createDataFrame([], MONITORED).write.parquet(f"{out}/batch=-1")
    return t.spark.read.schema(MONITORED).parquet(out), batch


SQL_WINDOWS = f"""ev AS (SELECT date_trunc('day', ts) AS w, ts, event_type, value FROM events),
closed AS (SELECT DISTINCT w FROM ev WHERE w + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR),
edges AS (SELECT event_type, quantile_cont(value, {EDGE_LIST}) AS e FROM ev WHERE ts < TIMESTAMP '2024-01-11' GROUP BY ALL),
binned AS (SELECT w, ts, event_type, len(list_filter(e, lambda x: x < value)) AS bin FROM ev JOIN edges USING (event_type)),
bins AS (SELECT unnest(range(10)) AS bin),
bc AS (SELECT event_type, bin, COUNT(*) AS c FROM binned WHERE ts < TIMESTAMP '2024-01-11' GROUP BY ALL),
base AS (SELECT event_type, bin, c / CAST(SUM(c) OVER (PARTITION BY event_type) AS DOUBLE) AS p FROM bc),
win AS (SELECT w, event_type, COUNT(*) AS n FROM binned JOIN closed USING (w) GROUP BY ALL),
cur AS (SELECT w, event_type, bin, COUNT(*) AS c FROM binned GROUP BY ALL),
sh AS (SELECT win.w, win.event_type, win.n, greatest(COALESCE(c, 0) / CAST(win.n AS DOUBLE), 1e-4) AS q, greatest(COALESCE(p, 0), 1e-4) AS p
  FROM win CROSS JOIN bins LEFT JOIN cur ON cur.w = win.w AND cur.event_type = win.event_type AND cur.bin = bins.bin
  LEFT JOIN base ON base.event_type = win.event_type AND base.bin = bins.bin)"""


@query("str1_stream_monitor", f"""
WITH {SQL_WINDOWS}
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n AS n_rows, round(SUM((q - p) * ln(q / p)), 6) AS psi FROM sh GROUP BY ALL""")
def str1(t):
    out, _ = _monitor(t)
    return out.select(utc_text(F.col("window_start")).alias("window_start"), "event_type", "n_rows", r("psi"))


@query("str1_late_rows", f"""
WITH {SQL_WINDOWS} SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n AS n_arrived, n AS n_rows, CAST(0 AS BIGINT) AS n_late FROM win""")
def str1_late(t):
    out, batch = _monitor(t)
    return late_rows(out, batch, "ts", WIDTH, ["event_type"], DELAY).select(
        utc_text(F.col("window_start")).alias("window_start"), "event_type", "n_arrived", "n_rows", "n_late")


@query("str2_delayed_labels", f"""
WITH p AS (SELECT event_id, ts FROM events WHERE ts <= (SELECT MAX(ts) FROM events) - INTERVAL 12 HOUR),
h AS (SELECT event_id, ts + to_minutes(CAST({sql_hash("'s1|delay|' || event_id")} % 1000 AS INTEGER)) AS label_ts,
  CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS label FROM events WHERE {sql_hash("'s1|seen|' || event_id")} % 1000 < 600)
SELECT COALESCE(label, '(none)') AS label, COUNT(*) AS n, CAST(SUM(p.event_id) AS BIGINT) AS id_sum
FROM p LEFT JOIN h ON h.event_id = p.event_id AND h.label_ts <= p.ts + INTERVAL 6 HOUR GROUP BY ALL""")
def str2(t):
    """Predictions and their outcomes as two streams; an outcome comes up to 16 hours later."""
    src = stream(t).withColumn("ts", instant(F.col("ts")))
    preds = src.select(F.col("event_id").alias("record_id"), F.col("ts").alias("scored_at"))
    late = F.make_dt_interval(F.lit(0), F.lit(0), hash_mille("s1", "delay", F.col("event_id")))
    outcomes = src.where(hash_mille("s1", "seen", F.col("event_id")) < 600).select(
        F.col("event_id").alias("record_id"), (F.col("ts") + late).alias("label_ts"),
        F.when(F.col("value") > 20, "high").otherwise("low").alias("label"))
    out, state = scratch_path(t.spark, "labels"), scratch_path(t.spark, "labels-state")
    q = (
        match_outcomes(preds, outcomes, "6 HOURS", "1 hour")
        .writeStream.outputMode("append").option("checkpointLocation", state)
        .trigger(availableNow=True).format("parquet").option("path", out).start()
    )
    q.awaitTermination()
    # predictions whose horizon had not closed when the source ended are still open
    last = t("events").agg(F.max("ts").alias("m")).select((F.col("m") - F.expr("INTERVAL 12 HOURS")).alias("m"))
    done = t.spark.read.schema(MATCHED).parquet(out).withColumn("one", F.lit(1)).join(
        F.broadcast(last.select(instant(F.col("m")).alias("m"), F.lit(1).alias("one"))), "one").where(F.col("scored_at") <= F.col("m"))
    return done.groupBy(F.coalesce("label", F.lit("(none)")).alias("label")).agg(
        F.count("*").alias("n"), F.sum("record_id").alias("id_sum"))
