"""Mixing sources to target weights by systematic sampling.

Every source has a target amount of words; each of its documents is expected ``target / size of the
source`` times.  The expected copies are summed up in order within the source, one random offset per
source is added, and a document is emitted once for every whole number its stretch crosses: never
fewer times than the rate rounded down, never more than rounded up.  The order is by falling size, then by a
digest, so neighbours are interchangeable and the words taken stay within about one document of the
target, while which of the equal-sized documents is taken looks random.  (Falling: the last stretch, whose
rest is lost to rounding, then belongs to the smallest document.)

Copies are exact integers: rates are held in units of 2**-24, so a run is reproducible to the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadfold.session import materialize

from .common import n_words, numbered, numbered_within, without

UNIT = 24  # bits after the point of a rate


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` for a table with one row per source.

    Sources, by code point with null last, take the weights in turn and share ``share`` of all sizes
    by weight; no target is above ``most`` times its source's size, and what is cut there is shared
    again by weight.  The end state is ``least(cap, weight * level)`` for one level, found by running
    sums over the sources ordered by cap per weight.  One row per source: this table is small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy(F.lit(1))
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))).alias("left"),
        (F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))).alias("w_left"))
    # The level is set by the first source, in this order, that does not reach its cap.
    t = t.withColumn("level", F.when(F.col("cap") > F.col("w") * F.col("left") / F.col("w_left"), F.col("left") / F.col("w_left")))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def systematic_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                   seed: str = "mix", text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
                   size_col: str | None = None, tie_col: str | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (words).

    ``size`` is the number of words of the text unless ``size_col`` gives it.  A null text has size 0;
    a null source is a source of its own, the last; documents of size 0 may be taken and add nothing;
    a source without any words has the target 0 and is not taken.  Rows equal in id and text are
    interchangeable.  Columns of the input called like a result are replaced.  An empty table gives
    an empty result.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.withColumn("__size", F.col(size_col).cast("long") if size_col else n_words(F.col(text_col)))
    docs = docs.withColumn("__tie", F.col(tie_col) if tie_col else tie(id_col, text_col)).withColumn("__source", F.col(source_col))
    docs = materialize(without(docs, made), "mix")
    sizes = docs.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * float(1 << UNIT))).otherwise(0.0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")))), 1, UNIT // 4), 16, 10).cast("long")
    goal = goal.select(F.col("source").alias("__goal"), "source_size", "target", rate.alias("__rate"), offset.alias("__offset"))
    rows = numbered(docs, ["__source"], [F.col("__size").desc(), F.col("__tie")], "__place")
    rows = rows.join(goal, F.col("__source").eqNullSafe(F.col("__goal")))
    upto = F.shiftright(F.col("__offset") + (F.col("__place") + 1) * F.col("__rate"), UNIT)
    copies = upto - F.shiftright(F.col("__offset") + F.col("__place") * F.col("__rate"), UNIT)
    rows = rows.withColumn("copies", copies).withColumnRenamed("__size", "size").withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("__tie", "__source", "__goal", "__rate", "__offset", "__place")


def tie(id_col: str, text_col: str):
    """Order among documents of one size: a digest of id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for every copy that the mix takes."""
    return mixed.where("copies > 0").withColumn(
        "__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("__copy")


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (see :func:`systematic_mix`), its columns unchanged.

    The mix is worked out on sizes and digests alone; the documents are shuffled once, to be joined
    with their copies.  Rows equal in id, text and source are interchangeable: what the mix takes of
    them is spread over them as evenly as it goes.
    """
    digest = tie(id_col, text_col)
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null")), F.lit("|"), digest))
    slim = docs.select(F.col(source_col).alias("__from"), n_words(F.col(text_col)).alias("__words"), digest.alias("__digest"), key.alias("__key"))
    mixed = systematic_mix(slim, source_col="__from", size_col="__words", tie_col="__digest", **options)
    groups = mixed.groupBy("__key").agg(F.count(F.lit(1)).alias("__rows"), F.sum("copies").alias("__copies")).where("__copies > 0")
    rows = numbered_within(docs.withColumn("__key", key), materialize(groups, "copies"), "__key", "__rows", "__no")
    copies = F.expr("CAST(__copies DIV __rows AS INT) + CAST(__no < __copies % __rows AS INT)")
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(docs.columns)
