"""Exact ranks and CDFs without a one-task window.

Three steps, each bounded per task:

1. collapse to distinct values with partial aggregation (a value that holds a third
   of all rows becomes one row, ties are handled by construction);
2. cut the *distinct* values of every group into even buckets;
3. running sums inside each bucket plus the totals of the buckets before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_bounded


def distinct_counts(df: DataFrame, groups: Sequence[str], x: str,
                    measures: Mapping[str, Column]) -> DataFrame:
    """One row per (groups, non-null x) with the integer sum of every measure."""
    return (
        df.where(F.col(x).isNotNull())
        .groupBy(*groups, x)
        .agg(*[F.sum(e).cast("bigint").alias(m) for m, e in measures.items()])
    )


def place(df: DataFrame, x: str, cuts: str, n_buckets: int, out: str) -> DataFrame:
    """Bucket of ``x`` among ``n_buckets - 1`` sorted cuts (``n_buckets`` a power of two).

    A binary search unrolled into one small projection per step: the generated code stays
    far below the size the JVM compiles, whatever the number of buckets.
    """
    step = n_buckets // 2
    df = df.withColumn(out, F.lit(0))
    while step:
        df = df.withColumn(out, F.expr(f"`{out}` + IF(`{x}` > `{cuts}`[`{out}` + {step - 1}], {step}, 0)"))
        step //= 2
    return df


def default_buckets(df: DataFrame) -> int:
    """Power of two covering the shuffle partitions, between 64 and 4096."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(max(wanted - 1, 63).bit_length(), 12)


def prefix_sums(counts: DataFrame, groups: Sequence[str], x: str, measures: Sequence[str],
                n_buckets: int | None = None, group_bound: int | None = None) -> DataFrame:
    """Add ``cum_m`` (running sum up to and including x), ``tot_m`` and ``next_x``.

    ``counts`` holds one row per (groups, x), see :func:`distinct_counts`.  It is read
    three times below.  The measures travel as one array, so that no reader is planned with
    fewer of them than another: all three share one shuffle, and the rows behind it are
    scanned once.  ``n_buckets`` (a power of two) is the parallelism inside one group; by
    default it follows the session's shuffle partitions, so that a large cluster gets small
    buckets.
    """
    if n_buckets is None:
        n_buckets = default_buckets(counts)
    if n_buckets < 2 or n_buckets & (n_buckets - 1):
        raise ValueError("n_buckets must be a power of two")
    groups = list(groups)
    levels = ", ".join(f"{i / n_buckets!r}D" for i in range(1, n_buckets))
    part = {m: F.col("__m")[i] for i, m in enumerate(measures)}
    packed = counts.select(*groups, x, F.array(*measures).alias("__m"))
    cuts = packed.groupBy(*groups).agg(
        F.expr(f"percentile_approx(`{x}`, array({levels}))").alias("__cuts"),
        *[F.sum(part[m]).alias(f"tot_{m}") for m in measures],
    )
    wide = None if group_bound is None else group_bound * n_buckets  # a row of cuts is as large as that many rows of one number
    keyed = place(join_bounded(packed, cuts, groups, rows=wide), x, "__cuts", n_buckets, "__b").drop("__cuts")

    order = Window.partitionBy(*groups).orderBy("__b")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    per_bucket = keyed.groupBy(*groups, "__b").agg(
        F.min(x).alias("__first"),
        *[F.sum(part[m]).alias(f"__s_{m}") for m in measures],
        *[F.max(f"tot_{m}").alias(f"__t_{m}") for m in measures],
    )
    offsets = per_bucket.select(
        *groups,
        "__b",
        F.lead("__first").over(order).alias("__next_first"),
        *[(F.col(f"__t_{m}") - F.sum(f"__s_{m}").over(rest)).alias(f"__o_{m}") for m in measures],
    )
    joined = join_bounded(keyed, offsets, [*groups, "__b"], rows=wide)
    inside = Window.partitionBy(*groups, "__b").orderBy(x)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *groups,
        x,
        *[part[m].alias(m) for m in measures],
        *[(F.sum(part[m]).over(upto) + F.col(f"__o_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"tot_{m}" for m in measures],
        F.coalesce(F.lead(x).over(inside), F.col("__next_first")).alias("next_x"),
    )


def exact_quantiles(counts: DataFrame, groups: Sequence[str], x: str, weight: str,
                    probs: Sequence[float], out: str = "edges",
                    group_bound: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group as one ARRAY<DOUBLE>, found by rank.

    Unlike the ``percentile`` aggregate this never holds a group's distinct values
    in one task.
    """
    groups = list(groups)
    ranked = prefix_sums(counts, groups, x, [weight], group_bound=group_bound)
    grid = F.expr("array(" + ", ".join(f"named_struct('i', {i}, 'p', {float(p)!r}D)" for i, p in enumerate(probs)) + ")")
    pos = F.col("p") * (F.col("n") - 1)
    hits = (
        ranked.select(*groups, F.col(x).alias("v"), (F.col(f"cum_{weight}") - F.col(weight)).alias("start"),
                      F.col(f"cum_{weight}").alias("stop"), F.col(f"tot_{weight}").alias("n"),
                      F.inline(grid))
        .withColumn("lo", F.floor(pos))
        .withColumn("hi", F.ceil(pos))
        .withColumn("frac", pos - F.col("lo"))
        .where((F.col("start") <= F.col("hi")) & (F.col("stop") > F.col("lo")))
    )
    holds = lambda r: (F.col("start") <= F.col(r)) & (F.col("stop") > F.col(r))
    points = hits.groupBy(*groups, "i", "frac").agg(
        F.max(F.when(holds("lo"), F.col("v"))).alias("a"),
        F.max(F.when(holds("hi"), F.col("v"))).alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")
    return (
        points.select(*groups, F.struct("i", value.alias("v")).alias("iv"))
        .groupBy(*groups)
        .agg(F.array_sort(F.collect_list("iv")).alias("ivs"))
        .select(*groups, F.col("ivs.v").alias(out))
    )
