"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfold.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
CROWD = 10_000  # rows of one key that one task may number


def n_words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns whose names an operator is about to use for its own results."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand batches of at most ``rows`` rows to Python: for whole texts, so that a batch stays a few MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number rows from 0, without gaps, inside each group, in ``order``.

    A group may hold any share of the rows: the table is range-partitioned by group and order,
    written, and each row's place is its place in its partition plus the rows of the group in
    earlier partitions.  Only (partition, group) counts meet in the second step.
    """
    rows = df.orderBy(*[F.col(g).asc_nulls_last() for g in groups], *order)
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), f"numbered-{name}")
    part = F.shiftright(F.col("__at"), 33)
    before = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], part.alias("__p"))
        .agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )
    same = part == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = rows.join(starts, same)
    return joined.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before")).drop(
        "__at", "__p", "__first", "__n", "__before", *[f"__g{i}" for i in range(len(groups))])


def numbered_within(rows: DataFrame, groups: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """``rows`` joined to ``groups`` on ``key`` and numbered from 0 inside each key, in any order.

    ``groups`` has one row per key with the number ``size`` of its rows; read it from a written
    table.  Wide rows are shuffled once, by key; keys of more than ``CROWD`` rows are numbered by ranges.
    """
    joined = rows.join(groups, key)
    few = joined.where(F.col(size) <= CROWD).withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(key)) - 1)
    crowded = groups.where(F.col(size) > CROWD)
    if crowded.isEmpty():
        return few
    many = numbered(joined.where(F.col(size) > CROWD), [key], [F.monotonically_increasing_id()], name)
    return few.unionByName(many.withColumn(name, F.col(name).cast("int")))
