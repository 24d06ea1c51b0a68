"""Reliability assessment on labelled predictions.

A *scored* table holds ``record_id``, ``label`` (NULL while the outcome is unknown),
``predicted`` and ``probs MAP<STRING,DOUBLE>``; ``by`` adds grouping keys (window,
model version, area).  Rows without a label never enter a metric.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import class_struct, safe_ratio
from ..session import join_bounded
from .prefix import distinct_counts, prefix_sums

PENDING_WORDING = "Potential reliability risk detected; outcome-based verification pending."

# +1: higher is better, -1: lower is better
METRIC_DIRECTION = {
    "accuracy": 1, "recall": 1, "precision": 1, "f1": 1, "macro_f1": 1,
    "auroc": 1, "auprc": 1, "ece": -1, "brier": -1, "nll": -1,
}


def one_vs_rest(scored: DataFrame, classes: Sequence[str], keep: Sequence[str] = (),
                probs: str = "probs", label: str = "label") -> DataFrame:
    """``(keep, class, score, y)``, one row per class of every labelled row."""
    return scored.where(F.col(label).isNotNull()).select(*keep, F.inline(class_struct(probs, label, classes)))


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.where(F.col("label").isNotNull()).groupBy(*by, "label", "predicted").agg(F.count("*").alias("n"))


def class_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision and F1 by class, with the macro F1 of the group on every row.

    Computed from the confusion table, so rows are aggregated once.
    """
    hit = F.col("label") == F.col("predicted")
    cells = confusion(scored, by).select(
        *by,
        F.inline(F.array(
            F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                     F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("called")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                     F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("called")),
        )),
    )
    per_class = cells.where(F.col("class").isNotNull()).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("called").alias("n_predicted")
    ).withColumns({
        "recall": safe_ratio(F.col("tp"), F.col("support")),
        "precision": safe_ratio(F.col("tp"), F.col("n_predicted")),
        "f1": safe_ratio(2 * F.col("tp"), F.col("support") + F.col("n_predicted")),
    })
    macro = per_class.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    if not by:
        return join_bounded(per_class.withColumn("__one", F.lit(1)), macro.withColumn("__one", F.lit(1)),
                            ["__one"], rows=1).drop("__one")
    return join_bounded(per_class, macro, by)


def score_counts(ovr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: all a ranking or calibration metric needs."""
    return distinct_counts(
        ovr.where(F.col("y").isNotNull()), [*by, "class"], "score",
        {"pos": F.col("y"), "neg": F.lit(1) - F.col("y")},
    )


def ranking_metrics(ovr: DataFrame, by: Sequence[str] = (), n_buckets: int | None = None,
                    group_bound: int | None = None) -> DataFrame:
    """AUROC (ties at half) and AUPRC (average precision) per (by, class).

    Both read one ranked table.  NULL when only one outcome is present.
    """
    return _ranking(score_counts(ovr, by), by, n_buckets, group_bound)


def _ranking(counts: DataFrame, by: Sequence[str], n_buckets: int | None = None,
             group_bound: int | None = None) -> DataFrame:
    ranked = prefix_sums(counts, [*by, "class"], "score", ["pos", "neg"], n_buckets, group_bound)
    below = F.col("cum_neg") - F.col("neg")
    win = F.col("pos") * (below + F.col("neg") / 2)
    # walking down from the highest score: everything at or above this value
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    ap = F.col("pos") * safe_ratio(tp, tp + fp)
    sums = ranked.groupBy(*by, "class").agg(
        F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg"),
        F.sum(win).alias("__win"), F.sum(ap).alias("__ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select(
        *by, "class", "n_pos", "n_neg",
        F.when(both, safe_ratio(F.col("__win"), pairs)).alias("auroc"),
        F.when(both, safe_ratio(F.col("__ap"), F.col("n_pos"))).alias("auprc"),
    )


def auroc(ovr: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(ovr, by, **kw).drop("auprc")


def auprc(ovr: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(ovr, by, **kw).drop("auroc")


def reliability_table(ovr: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width score bins: volume, mean score, observed rate and their gap."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return (
        ovr.where(F.col("y").isNotNull() & F.col("score").isNotNull())
        .groupBy(*by, "class", b.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.avg("y").alias("avg_y"))
        .withColumn("gap", F.abs(F.col("avg_score") - F.col("avg_y")))
    )


def ece(ovr: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    table = reliability_table(ovr, bins, by)
    return table.groupBy(*by, "class").agg(
        F.sum("n").alias("n"),
        safe_ratio(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("ece"),
    )


def brier(scored: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Brier score summed over the classes (twice the one-column form when binary)."""
    total: Column = F.lit(0.0)
    for c in classes:
        total = total + F.pow(F.col("probs")[F.lit(c)] - (F.col("label") == F.lit(c)).cast("int"), F.lit(2))
    return scored.where(F.col("label").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(total).alias("brier")
    )


def metrics_long(scored: DataFrame, classes: Sequence[str], bins: int = 10,
                 by: Sequence[str] = (), group_bound: int | None = None) -> DataFrame:
    """Every reliability metric as ``(by, metric, class, value)`` rows.

    ``class`` is ``all`` for group-level metrics.  Rows are aggregated twice only, to the
    confusion table and to counts per distinct score; ranking, calibration and Brier all
    follow from the latter.
    """
    per_class = class_metrics(scored, by)
    counts = score_counts(one_vs_rest(scored, classes, by), by)
    n = F.col("pos") + F.col("neg")
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    squares = F.col("pos") * F.pow(F.col("score") - 1, F.lit(2)) + F.col("neg") * F.pow("score", F.lit(2))
    table = counts.groupBy(*by, "class", b.alias("bin")).agg(
        F.sum(n).alias("n"), F.sum(F.col("score") * n).alias("s"), F.sum("pos").alias("o"), F.sum("neg").alias("neg"),
        F.sum(squares).alias("sq"))
    calibration = table.groupBy(*by, "class").agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq"),
        safe_ratio(F.sum(F.abs(F.col("s") - F.col("o"))), F.sum("n")).alias("ece"))
    rank = _ranking(counts, by, group_bound=group_bound)
    whole = {"class": F.lit("all")}
    parts = [
        per_class.unpivot([*by, "class"], ["recall", "precision", "f1"], "metric", "value"),
        per_class.groupBy(*by).agg(F.max("macro_f1").alias("value")).withColumns({**whole, "metric": F.lit("macro_f1")}),
        rank.unpivot([*by, "class"], ["auroc", "auprc"], "metric", "value"),
        calibration.select(*by, "class", F.lit("ece").alias("metric"), F.col("ece").alias("value")),
        calibration.groupBy(*by).agg(safe_ratio(F.sum("sq"), F.max("n")).alias("value")).withColumns(
            {**whole, "metric": F.lit("brier")}),
    ]
    out = parts[0].select(*by, "metric", "class", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select(*by, "metric", "class", "value"))
    return out


# ------------------------------------------------------------------- delayed labels


def attach_labels(preds: DataFrame, outcomes: DataFrame, as_of, record_id: str = "record_id") -> DataFrame:
    """Left join of the newest label known at ``as_of``; later labels stay invisible."""
    limit = as_of if isinstance(as_of, Column) else F.lit(as_of)
    newest = (
        outcomes.where(F.col("label_ts") <= limit)
        .groupBy(record_id)
        .agg(F.max(F.struct("label_ts", "label")).alias("__l"))
        .select(record_id, F.col("__l.label").alias("label"), F.col("__l.label_ts").alias("label_ts"))
    )
    return preds.join(newest, record_id, "left")


def label_coverage(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("label").alias("n_labelled"),
    ).withColumn("coverage", safe_ratio(F.col("n_labelled"), F.col("n")))


def reliability_status(windows: DataFrame, limits: Mapping[str, float], min_coverage: float) -> DataFrame:
    """``ok`` / ``degraded`` / ``pending`` from coverage and metric columns.

    ``limits`` maps a metric column to its limit (direction from METRIC_DIRECTION).
    While labels are missing the status is pending and the report never claims failure.
    """
    broken: Column = F.lit(False)
    known: Column = F.lit(True)
    for metric, limit in limits.items():
        c = F.col(metric)
        broken = broken | F.coalesce(c < limit if METRIC_DIRECTION[metric] > 0 else c > limit, F.lit(False))
        known = known & c.isNotNull()
    unlabelled = (F.coalesce(F.col("coverage"), F.lit(0.0)) < min_coverage) | ~known
    shifted = F.coalesce(F.col("shift_detected"), F.lit(False)) if "shift_detected" in windows.columns else F.lit(True)
    status = F.when(unlabelled, "pending").when(broken, "degraded").otherwise("ok")
    return windows.withColumn("status", status).withColumn(
        "message",
        F.when((F.col("status") == "pending") & shifted, PENDING_WORDING)
        .when(F.col("status") == "pending", "No shift detected; reliability unverified until labels arrive.")
        .when(F.col("status") == "degraded", "Reliability below the accepted limits.")
        .otherwise("Reliability within the accepted limits."),
    )


def _direction(metric: Column) -> Column:
    return F.when(metric.isin([m for m, d in METRIC_DIRECTION.items() if d > 0]), 1.0).when(
        metric.isin([m for m, d in METRIC_DIRECTION.items() if d < 0]), -1.0
    )


def degradation(current: DataFrame, base: DataFrame, keys: Sequence[str] = ("metric", "class")) -> DataFrame:
    """Loss against the frozen baseline; positive means worse, whatever the metric."""
    frozen = base.select(*keys, F.col("value").alias("base_value"))
    return join_bounded(current, frozen, list(keys)).withColumn(
        "degradation", (F.col("base_value") - F.col("value")) * _direction(F.col("metric"))
    )


def shift_impact(results: DataFrame, by: Sequence[str] = ("metric",), shift: str = "shift",
                 loss: str = "degradation") -> DataFrame:
    """How strongly a shift measure goes with reliability loss over windows or scenarios."""
    pair = F.col(shift).isNotNull() & F.col(loss).isNotNull()
    return results.where(pair).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.corr(shift, loss).alias("corr"),
        F.regr_slope(loss, shift).alias("slope"),
    )
