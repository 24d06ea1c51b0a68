from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from steadfold import plans
from steadfold.operators import shift
from steadfold.session import scratch_path
from steadfold.streaming import late_rows, match_outcomes, monitor_windows, run_monitor

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def write(spark, path, rows, schema, n):
    """One file per call: files are read in the order they were written."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_monitor_equals_batch_and_counts_late_rows(spark):
    src = scratch_path(spark, "events")
    schema = "ts timestamp, feature string, value double"
    on_time = [(at(h / 4), "v", float(h % 17)) for h in range(0, 24 * 4 * 3)]
    write(spark, src, on_time, schema, 1)
    write(spark, src, [(at(100), "v", 1.0)], schema, 2)
    late = [(at(5), "v", 3.0), (at(6), "v", 3.0), (at(7), "w", 3.0)]  # of "w" nothing was in time
    write(spark, src, late, schema, 3)
    write(spark, src, [(at(200), "v", 1.0)], schema, 4)

    batch = spark.createDataFrame(on_time, schema)
    edges = shift.fit_edges(batch.where(F.col("ts") < F.lit(at(24)))).persist()
    base = shift.histogram(batch.where(F.col("ts") < F.lit(at(24))), edges, ["feature"], ["feature"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "monitor")
    run_monitor(monitor_windows(stream, edges, "ts", "1 day", "1 hour"), base, out, scratch_path(spark, "state")).awaitTermination()

    got = spark.read.parquet(out)
    closed = got.where(F.col("window_start") < F.lit(at(72)))
    long = batch.select(F.window("ts", "1 day")["start"].cast("string").alias("window_id"), "feature", "value")
    ref = long.agg(F.min("window_id")).first()[0]
    want = {r["window_id"]: r["psi"] for r in shift.psi(long, edges, ref).collect()}
    for r in closed.collect():
        key = str(r["window_start"])
        assert r["n_rows"] == 96
        if key != ref:
            assert abs(r["psi"] - want[key]) < 1e-9
    assert closed.count() == 3
    arrived = spark.read.schema(schema).parquet(src)
    counted = {(r["feature"], r["window_start"]): (r["n_rows"], r["n_late"])
               for r in late_rows(got, arrived, "ts", "1 day", delay="1 hour").collect()}
    assert sorted(v for (f, _), v in counted.items() if f == "v") == [(1, 0), (96, 0), (96, 0), (96, 2)]
    assert [v for (f, _), v in counted.items() if f == "w"] == [(0, 1)]


def test_registered_streams_read_a_folder_of_parts(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{folder}/events.parquet")
    for name in ("str1_stream_monitor", "str1_late_rows", "str2_delayed_labels"):
        file, parts = (sorted(map(str, plans.queries()[name](spark, d).collect())) for d in (sf_dir, folder))
        assert file == parts and file
    empty = scratch_path(spark, "tables")
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{empty}/events.parquet")
    assert plans.queries()["str1_stream_monitor"](spark, empty).count() == 0


def test_labels_arrive_later_or_never(spark):
    preds, outs = scratch_path(spark, "preds"), scratch_path(spark, "outs")
    ps, os_ = "record_id string, scored_at timestamp", "record_id string, label string, label_ts timestamp"
    write(spark, preds, [("a", at(0)), ("b", at(0)), ("c", at(1))], ps, 1)
    write(spark, outs, [("a", "SAM", at(3)), ("c", "MAM", at(20))], os_, 1)
    # closing events move both watermarks past every horizon
    write(spark, preds, [("z", at(500))], ps, 2)
    write(spark, outs, [("y", "MAM", at(500))], os_, 2)
    read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p)
    out = scratch_path(spark, "matched")
    q = (match_outcomes(read(preds, ps), read(outs, os_), "6 HOURS", "1 hour").writeStream.outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True)
         .format("parquet").option("path", out).start())
    q.awaitTermination()
    got = {r["record_id"]: r["label"] for r in spark.read.parquet(out).collect()}
    assert {k: got[k] for k in "abc"} == {"a": "SAM", "b": None, "c": None}  # c's label is past the horizon
