"""Several tables published together: readers see all tables of a run, or none of them.

A run's tables are written to folders of the attempt, under names that no reader looks for.  Then one
row is added to the manifests: a single file, put in place by the write's commit.  That is the moment of
publication.  An attempt that dies before leaves folders that no manifest names, and the run that
was published before it stays as it was.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "run_id string, published_at_us long, attempt string, tables map<string, string>, schemas map<string, string>"


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, run_id: str,
            partition_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Write ``tables`` (name: rows) of one run under ``root``, then commit them together; returns the attempt.

    ``partition_by`` names the folder columns of a table.  A later attempt of the same run replaces all
    its tables at once, also those it does not name.  An empty table is published as empty.
    """
    attempt = f"{quote(run_id, safe='')}-{os.urandom(6).hex()}"
    folders, schemas = {}, {}
    for name, rows in tables.items():
        folders[name] = f"data/{quote(name, safe='')}/{attempt}"
        schemas[name] = rows.schema.json()
        rows.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{root}/{folders[name]}")

    def text_map(entries: Mapping[str, str]):
        flat = [F.lit(x) for entry in entries.items() for x in entry]
        return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")

    row = spark.range(0, 1, 1, 1).select(
        F.lit(run_id).alias("run_id"), F.lit(time.time_ns() // 1000).alias("published_at_us"), F.lit(attempt).alias("attempt"),
        text_map(folders).alias("tables"), text_map(schemas).alias("schemas"))
    row.write.mode("append").json(f"{root}/manifests")
    return attempt


def published(spark: SparkSession, root: str) -> DataFrame:
    """The manifest that holds for each run: its last one."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MANIFEST)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), F.struct("published_at_us", "attempt")).alias("m"))
    return last.select("m.*")


def read_published(spark: SparkSession, root: str, name: str, run_ids: Sequence[str] | None = None) -> DataFrame:
    """Rows of table ``name`` of the published runs (or of ``run_ids``), with ``run_id``.

    Partition columns keep the type they were written with.  A run without this table adds nothing; if
    no published run has it, that is a ``LookupError``.
    """
    runs = published(spark, root).where(F.col("tables")[name].isNotNull())
    if run_ids is not None:
        runs = runs.where(F.col("run_id").isin(list(run_ids)))
    found = runs.select("run_id", F.col("tables")[name].alias("folder"), F.col("schemas")[name].alias("schema")).orderBy("run_id").collect()
    if not found:
        raise LookupError(f"no published run has a table {name!r}")
    out = None
    for run in found:  # one row per run; runs are snapshots or report dates
        part = spark.read.schema(StructType.fromJson(json.loads(run.schema))).parquet(f"{root}/{run.folder}").withColumn("run_id", F.lit(run.run_id))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

