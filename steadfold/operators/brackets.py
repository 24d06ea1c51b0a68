"""Exact quantiles without shuffling values.

Every wanted rank is held by a bracket, an interval of values that contains it.  A pass over the rows
counts each bracket in bins and keeps the bin with the rank, narrowed to the smallest and largest value
seen there; a bracket of one value is the answer.  What is shuffled is bins, whatever the number of
rows or of distinct values: at most ``groups * brackets * bins`` rows from a task and pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_bounded, materialize


def bracket_quantiles(df: DataFrame, groups: Sequence[str], x: str, probs: Sequence[float], out: str = "edges",
                      bins: int = 1024, group_bound: int | None = None) -> tuple[DataFrame, int]:
    """Linear-interpolation quantiles per group as one ARRAY<DOUBLE>, and the number of passes.

    ``df`` is read once for the extremes and once a pass: cache or write it when it is dear to make.
    NULL and NaN are left out, infinities count as the largest and smallest double; a group without a
    value has no row.  Bins are even on the values and on their logarithms by turns, so values of very
    different size narrow as well; a bracket of more than one value loses at least one a pass.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    groups = list(groups)
    most = 1.7976931348623157e308
    v = F.greatest(F.least(F.col(x).cast("double"), F.lit(most)), F.lit(-most)) + F.lit(0.0)
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*groups, v.alias("__x"))
    ranks = F.expr("array(" + ", ".join(f"named_struct('i', {i}, 'p', {float(p)!r}D)" for i, p in enumerate(probs)) + ")")
    ends = rows.groupBy(*groups).agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count("*").alias("n"))
    pos = F.col("p") * (F.col("n") - 1)
    state = materialize(
        ends.select(*groups, "lo", "hi", "n", F.inline(ranks))
        .select(*groups, "lo", "hi", F.lit(0).cast("bigint").alias("below"), "i", (pos - F.floor(pos)).alias("frac"),
                F.explode(F.array(F.struct(F.lit(False).alias("upper"), F.floor(pos).alias("rank")),
                                  F.struct(F.lit(True).alias("upper"), F.ceil(pos).alias("rank")))).alias("r"))
        .select(*groups, "lo", "hi", "below", "i", "frac", "r.*"), "brackets")
    passes = 0
    while not (wide := state.where("lo < hi")).isEmpty():
        passes += 1
        spans = wide.groupBy(*groups).agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))
        # brackets of a group are equal or apart, so a row lies in one at most, and they are two a quantile at most
        hit = join_bounded(rows, spans, groups, rows=group_bound).select(
            *groups, "__x", F.explode("__spans").alias("s")).where("__x BETWEEN s.lo AND s.hi")
        at = (lambda c: f"{c} / 2") if passes % 2 else (lambda c: f"IF({c} = 0, 0D, signum({c}) * (ln(abs({c})) + 750))")
        share = F.expr(f"floor(try_divide({at('__x')} - {at('s.lo')}, {at('s.hi')} - {at('s.lo')}) * {bins})")
        bin_ = F.when(F.col("__x") == F.col("s.lo"), 0).when(F.col("__x") == F.col("s.hi"), bins - 1).otherwise(
            F.least(F.coalesce(share, F.lit(0)), F.lit(bins - 1))).cast("int")
        counted = hit.groupBy(*groups, "s.lo", "s.hi", bin_.alias("__bin")).agg(
            F.count("*").alias("c"), F.min("__x").alias("first"), F.max("__x").alias("last"))
        upto = Window.partitionBy(*groups, "lo", "hi").orderBy("__bin")  # at most `bins` rows
        placed = counted.withColumn("upto", F.sum("c").over(upto)).groupBy(*groups, "lo", "hi").agg(
            F.collect_list(F.struct("upto", "c", "first", "last")).alias("__bins"))
        held = F.expr("get(filter(__bins, b -> below + b.upto > rank AND below + b.upto - b.c <= rank), 0)")
        narrowed = join_bounded(wide, placed, [*groups, "lo", "hi"]).withColumn("b", held).select(
            *groups, F.col("b.first").alias("lo"), F.col("b.last").alias("hi"),
            (F.col("below") + F.col("b.upto") - F.col("b.c")).alias("below"), "i", "frac", "upper", "rank")
        state = materialize(state.where("lo = hi").unionByName(narrowed), "brackets")
    a, b = (F.max(F.when(F.col("upper") == u, F.col("lo"))) for u in (False, True))
    points = state.groupBy(*groups, "i", "frac").agg(a.alias("a"), b.alias("b"))
    found = points.select(*groups, F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("v")).alias("iv"))
    return found.groupBy(*groups).agg(F.array_sort(F.collect_list("iv")).alias("ivs")).select(*groups, F.col("ivs.v").alias(out)), passes
