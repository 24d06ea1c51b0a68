"""Append-only result tables: shift flags, decisions, version history, burden, demand."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

REPORT_TABLES = ("shift_flags", "decisions", "version_history", "recommendations", "burden", "demand")


def append_report(df: DataFrame, root: str, table: str, run_id: str,
                  partition_by: Sequence[str] = ()) -> str:
    """Write one run of a report under ``root/table/run_id=...``.

    A run owns its folder: repeating it after a lost executor or a failed driver replaces the
    run with all its partitions instead of doubling it, other runs are never touched.
    """
    if table not in REPORT_TABLES:
        raise ValueError(f"unknown report {table!r}")
    path = f"{root}/{table}"
    own = df.drop("run_id").write.mode("overwrite").option("partitionOverwriteMode", "static")
    (own.partitionBy(*partition_by) if partition_by else own).parquet(f"{path}/run_id={quote(run_id, safe='')}")
    return path


def read_report(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")
