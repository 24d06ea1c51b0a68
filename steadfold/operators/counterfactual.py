"""Feasible recommendations: which modifiable changes would improve the prediction?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_BOUND, join_bounded, materialize
from .paths import relax


def feasible_moves(records: DataFrame, features: Sequence[str], policy: DataFrame,
                   record_id: str = "record_id", n_policy: int | None = None) -> DataFrame:
    """Allowed moves of every record: an equi-join on (feature, current value)."""
    long = records.select(record_id, *[F.col(f).cast("string").alias(f) for f in features]).unpivot(
        record_id, list(features), "feature", "from_value")
    allowed = policy.where("feasible").select("feature", "from_value", "to_value", "cost")
    return join_bounded(long, allowed, ["feature", "from_value"], rows=n_policy)


def linear_score(features: Sequence[str], weights: Mapping[tuple[str, str], float], bias: float) -> Column:
    """Fixed linear risk over categorical values; values without a weight add nothing."""
    total: Column = F.lit(float(bias))
    for f in features:
        w: Column = F.lit(0.0)
        for (feature, value), x in weights.items():
            if feature == f:
                w = F.when(F.col(f) == value, F.lit(float(x))).otherwise(w)
        total = total + w
    return total


def counterfactuals(records: DataFrame, features: Sequence[str], policy: DataFrame,
                    weights: Mapping[tuple[str, str], float], bias: float, threshold: float,
                    max_changes: int = 2, record_id: str = "record_id",
                    n_policy: int | None = None) -> DataFrame:
    """Every combination of allowed moves that takes a record below the risk threshold.

    Feature after feature, a row is fanned out to "stay" and its allowed moves, and rows
    with more than ``max_changes`` are dropped at once.  The policy is grouped to one row per
    current value, so records are never shuffled and the fan-out is bounded by the policy.

    Output: ``(record_id, score, new_score, cost, n_changes, changed_set, changes)``.
    """
    def weight(feature: str, value: Column) -> Column:
        w: Column = F.lit(0.0)
        for (f, v), x in weights.items():
            if f == feature:
                w = F.when(value == v, F.lit(float(x))).otherwise(w)
        return w

    allowed = policy.where("feasible")
    state = records.select(record_id, *features).withColumn("score", linear_score(features, weights, bias))
    state = state.where(F.col("score") >= threshold).withColumns({
        "new_score": F.col("score"), "cost": F.lit(0.0), "n_changes": F.lit(0),
        "changed_set": F.array().cast("array<string>"), "changes": F.array().cast("array<string>"),
    })
    for f in features:
        options = allowed.where(F.col("feature") == f).groupBy(F.col("from_value").alias("__from")).agg(
            F.collect_list(F.struct(
                F.col("to_value").alias("to"), F.col("cost").alias("c"),
                (weight(f, F.col("to_value")) - weight(f, F.col("from_value"))).alias("d"))).alias("__opts"))
        if n_policy is not None and n_policy <= BROADCAST_ROW_BOUND:
            options = F.broadcast(options)
        stay = F.array(F.struct(F.lit(None).cast("string").alias("to"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d")))
        moved = F.col("__m.to").isNotNull()
        state = (
            state.join(options, F.col(f) == F.col("__from"), "left")
            .withColumn("__m", F.explode(F.concat(stay, F.coalesce(F.col("__opts"), F.array().cast(
                "array<struct<to:string,c:double,d:double>>")))))
            .where(F.col("n_changes") + moved.cast("int") <= max_changes)
            .withColumns({
                "new_score": F.col("new_score") + F.col("__m.d"),
                "cost": F.col("cost") + F.col("__m.c"),
                "n_changes": F.col("n_changes") + moved.cast("int"),
                "changed_set": F.when(moved, F.concat("changed_set", F.array(F.lit(f)))).otherwise(F.col("changed_set")),
                "changes": F.when(moved, F.concat("changes", F.array(
                    F.concat(F.lit(f"{f}: "), F.col(f), F.lit(" -> "), F.col("__m.to"))))).otherwise(F.col("changes")),
            })
            .drop("__from", "__opts", "__m")
        )
    return state.where((F.col("n_changes") > 0) & (F.col("new_score") < threshold)).select(
        record_id, "score", "new_score", "cost", "n_changes",
        F.array_join("changed_set", "+").alias("changed_set"), F.array_join("changes", "; ").alias("changes"),
    )


def top_recommendations(found: DataFrame, k: int, record_id: str = "record_id") -> DataFrame:
    """The ``k`` cheapest counterfactuals per record, at most one per set of changed features.

    The best of each set is an aggregate, combined map-side, so even a record id shared by
    many rows reaches the ranking with one row per set of features.
    """
    fields = ["cost", "new_score", "changes", "n_changes", "score"]
    best = found.groupBy(record_id, "changed_set").agg(F.min(F.struct(*fields)).alias("b"))
    per_record = Window.partitionBy(record_id).orderBy("b.cost", "b.new_score", "b.changes")
    return best.withColumn("rank", F.row_number().over(per_record)).where(F.col("rank") <= k).select(
        record_id, "b.score", "b.new_score", "b.cost", "b.n_changes", "changed_set", "b.changes", "rank")


def attach_review(recommendations: DataFrame, reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expert review status; a recommendation nobody has looked at is ``pending``."""
    return recommendations.join(reviews.select(*keys, "review_status"), list(keys), "left").withColumn(
        "review_status", F.coalesce("review_status", F.lit("pending")))


# ------------------------------------------------------------------ feasible paths


def density_cells(records: DataFrame, steps: Mapping[str, float], score: Column, threshold: float,
                  min_share: float) -> DataFrame:
    """Records collapsed to a grid: ``(c_<feature>.., n, share, dense, goal)``.

    ``score`` reads the cell centres, named like the features.  However many records share
    a cell, it is one row, so no step compares records with each other.
    """
    cells = records.select(*[F.floor(F.col(f) / F.lit(float(w))).cast("int").alias(f"c_{f}") for f, w in steps.items()])
    counted = cells.groupBy(*cells.columns).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("__t")).withColumn("__one", F.lit(1))
    centred = join_bounded(counted.withColumn("__one", F.lit(1)), total, ["__one"], rows=1).withColumns(
        {f: (F.col(f"c_{f}") + 0.5) * F.lit(float(w)) for f, w in steps.items()})
    share = F.col("n") / F.col("__t")
    return centred.select(
        *cells.columns, "n", share.alias("share"), (share >= min_share).alias("dense"),
        (score < threshold).alias("goal"),
    )


def feasible_paths(cells: DataFrame, moves: Mapping[str, Sequence[int]], unit_cost: Mapping[str, float],
                   max_steps: int | None = None) -> DataFrame:
    """Cheapest path of single-feature steps to a goal cell.

    Steps go only to dense cells, in the directions ``moves`` allows, and cost more where
    records are rare: ``unit_cost * -ln(share of the entered cell)``.  Costs are relaxed
    backwards from all goals at once; only cells that became cheaper send offers, and rounds end
    when none did (see :func:`.paths.relax`).

    Output: the cells with ``path_cost``, ``path_steps`` and the next cell ``next_<feature>``
    (NULL where no path exists).  With ``max_steps`` also ``limit_reached``: were rounds left when
    paths stopped at that many steps, so that a longer one may exist or be cheaper?
    """
    if min(unit_cost.values()) < 0:
        raise ValueError("steps of negative cost have no cheapest path")
    coords = [c for c in cells.columns if c.startswith("c_")]
    cells = materialize(cells, "cells")
    usable = cells.where("dense")
    steps = []
    for f, directions in moves.items():
        for d in directions:
            steps.append(F.struct(*[
                (F.col(c) + (d if c == f"c_{f}" else 0)).cast("int").alias(f"next_{c[2:]}") for c in coords
            ], F.lit(float(unit_cost[f])).alias("__unit")))
    fan = cells.select(*coords, F.inline(F.array(*steps)))
    target = usable.select(*[F.col(c).alias(f"next_{c[2:]}") for c in coords], F.col("share").alias("__share"))
    nexts = [f"next_{c[2:]}" for c in coords]
    edges = materialize(fan.join(target, nexts).select(
        *coords, *nexts, (F.col("__unit") * -F.ln("__share")).alias("w")), "edges")
    best, _, left = relax(edges, usable.where("goal"), coords, nexts, max_steps)
    paths = cells.join(best, coords, "left")
    return paths if max_steps is None else paths.withColumn("limit_reached", F.lit(left))


def record_paths(records: DataFrame, steps: Mapping[str, float], paths: DataFrame,
                 record_id: str = "record_id") -> DataFrame:
    """First step and cost of the feasible path of every record, looked up by its cell."""
    placed = records.select(record_id, *[
        F.floor(F.col(f) / F.lit(float(w))).cast("int").alias(f"c_{f}") for f, w in steps.items()])
    return placed.join(paths, [f"c_{f}" for f in steps], "left")
