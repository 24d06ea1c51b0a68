"""Annual cross-sectional snapshots with schemas that differ by year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SnapshotSource:
    """One year's files: where they are, how they look, what their columns mean here."""

    year: int
    path: str | Sequence[str]
    schema: str
    fmt: str = "parquet"
    rename: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)


def read_snapshots(spark: SparkSession, sources: Sequence[SnapshotSource],
                   year_col: str = "snapshot_year") -> list[DataFrame]:
    """One DataFrame per source, columns renamed to the common vocabulary, year tagged.

    The year is a literal, so a filter on it prunes whole sources at planning time.
    """
    frames = []
    for s in sources:
        paths = s.path if isinstance(s.path, str) else list(s.path)
        raw = spark.read.format(s.fmt).options(**s.options).schema(s.schema).load(paths)
        frames.append(raw.select(
            F.lit(s.year).cast("int").alias(year_col),
            *[F.col(c).alias(s.rename.get(c, c)) for c in raw.columns if c != year_col],
        ))
    return frames


def align(frames: Sequence[DataFrame]) -> DataFrame:
    """Union narrow and rich snapshots; a variable a year never collected is NULL there.

    The NULLs are for storage only: see ``coverage`` for what is comparable.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
