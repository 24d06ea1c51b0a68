"""Session settings, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only when its row count is bounded by construction
# and the bound is at most this; otherwise the join is left to Spark, which
# chooses from the sizes it measures at run time.
BROADCAST_ROW_BOUND = 100_000


def local_session(cores: int | str = "*", app: str = "steadfold", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks (clusters bring their own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()  # <what was set>/<a folder of this application>
    if existing:
        return os.path.dirname(existing).removeprefix("file:")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="steadfold-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name under :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that an iterative plan survives lost executors."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Later plans start from a pruned parquet scan instead of the whole history, and nothing
    has to be recomputed when an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_bounded(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                 rows: int | None = None) -> DataFrame:
    """Null-safe equi-join on ``keys`` against a side of at most ``rows`` rows.

    ``rows`` is a bound that holds by construction (number of features, classes,
    policy lines).  Without one, or above the limit, no hint is given and Spark
    picks the strategy at run time, splitting skewed partitions if it shuffles.
    """
    renamed = small
    cond = F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    if rows is not None and rows <= BROADCAST_ROW_BOUND:
        renamed = F.broadcast(renamed)
    return big.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A policy or limit table given in code; no Python worker is needed to read it."""
    fields = [f.split(None, 1) for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t.strip()).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
