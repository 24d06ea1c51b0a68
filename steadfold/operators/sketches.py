"""Shift monitoring on stored summaries: a new window is compared without reading the old ones again.

A summary is one row per (window, feature) with counts and a mergeable quantile sketch (KLL).  Summaries
are kept as a table; a new window is summarized in one pass over its own rows and added, and every
comparison reads summaries only.  Sketches of parts (days, sources) merge into those of a window with no
other error than that of a sketch made at once.  A sketch keeps a few times ``k`` values, however many
rows there are, and is combined map-side; no value is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..session import join_bounded, materialize
from .shift import histogram, with_reference

K = 800
GRID = 1000  # steps in which the rank of an edge is read from a sketch, whose functions take constants only


def rank_error(k: int = K, share: bool = False) -> float:
    """Bound on the error of a rank (or of the share of values between two edges) in one sketch.

    Twice the published 99 % error of KLL sketches, that is about five standard deviations: one rank in
    some millions lies beyond it.  The error depends on ``k`` alone, not on the number of rows.
    """
    # The published fit of the error of KLL sketches at 99 % confidence.
    return 2 * (2.446 / k**0.9433 if share else 2.296 / k**0.9021)


def summarize(long: DataFrame, window: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``(window, feature, by, n, n_missing, sketch)`` of a long table.

    NULL and NaN count as missing; a group without a value has a sketch without values.
    """
    value = F.col("value").cast("double")
    seen = F.when(~F.isnan(value), value)
    return long.groupBy(window, "feature", *by).agg(
        F.count("*").alias("n"), (F.count("*") - F.count(seen)).alias("n_missing"),
        F.kll_sketch_agg_double(seen, F.lit(k)).alias("sketch"))


def merge(summaries: DataFrame, window: str, into: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One summary per window, or per value of ``into`` (say the year of a day), from those of its parts."""
    key = (F.col(window) if into is None else into).alias(window)
    return summaries.groupBy(key, "feature", *by).agg(
        F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _constant(numbers: Sequence[float]) -> Column:
    """An array that Spark folds to one literal."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _bounds(p: Column, q: Column, err: float, eps: float) -> tuple[Column, Column]:
    """Smallest and largest PSI term when both shares may be off by ``err``."""
    def ends(x: Column) -> tuple[Column, Column]:
        return F.greatest(x - err, F.lit(eps)), F.least(F.greatest(x + err, F.lit(eps)), F.lit(1.0))

    def term(a: Column, b: Column) -> Column:
        return (b - a) * F.ln(b / a)

    (p0, p1), (q0, q1) = ends(p), ends(q)
    low = F.when(p1 < q0, term(p1, q0)).when(q1 < p0, term(p0, q1)).otherwise(0.0)
    return low, F.greatest(term(p0, q1), term(p1, q0))


def stored_psi(summaries: DataFrame, ref, window: str = "window_id", by: Sequence[str] = (), n_bins: int = 10,
               eps: float = 1e-4, k: int = K) -> DataFrame:
    """PSI of every window against the reference window, from summaries alone.

    Edges are the reference sketch's quantiles.  ``psi_low`` and ``psi_high`` enclose the PSI that counting
    all rows between these edges would give, ``ranks`` are the window's shares up to each edge and
    ``rank_error`` their bound (that of the sketch and one step of ``GRID``).  Without a value on either side these are NULL; without a summary of the
    reference window all PSI are.
    """
    groups = ["feature", *by]
    both = with_reference(summaries.select(window, *groups, "n", "n_missing", "sketch"), window, ref, groups,
                          ["n", "n_missing", "sketch"])
    filled = (F.col("n") > F.col("n_missing")) & (F.col("r_n") > F.col("r_n_missing"))
    probs, grid = _constant([i / n_bins for i in range(1, n_bins)]), _constant([i / GRID for i in range(1, GRID + 1)])
    out = both.withColumn("edges", F.when(filled, F.kll_sketch_get_quantile_double("r_sketch", probs)))
    for side in ("", "r_"):
        out = out.withColumn("__grid", F.when(filled, F.kll_sketch_get_quantile_double(f"{side}sketch", grid))).withColumn(
            f"{side}ranks", F.transform("edges", lambda e: F.size(F.filter("__grid", lambda x: x <= e)) / GRID))
    step = 1 / GRID

    def shares(side: str) -> list[Column]:
        at = [F.lit(0.0), *[F.col(f"{side}ranks")[i] for i in range(n_bins - 1)], F.lit(1.0)]
        return [b - a for a, b in zip(at, at[1:])]

    out = out.withColumns({f"__p{i}": c for i, c in enumerate(shares("r_"))} | {f"__q{i}": c for i, c in enumerate(shares(""))})
    psi, low, high = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(n_bins):
        p, q = F.greatest(F.col(f"__p{i}"), F.lit(eps)), F.greatest(F.col(f"__q{i}"), F.lit(eps))
        least, most = _bounds(F.col(f"__p{i}"), F.col(f"__q{i}"), rank_error(k, share=True) + step, eps)
        psi, low, high = psi + (q - p) * F.ln(q / p), low + least, high + most
    missing = safe_ratio(F.col("n_missing"), F.col("n"))
    return out.where(F.col(window) != F.lit(ref)).select(
        window, *groups, "n", missing.alias("missing_rate"),
        (missing - safe_ratio(F.col("r_n_missing"), F.col("r_n"))).alias("missing_change"),
        *[F.when(filled, c).alias(name) for c, name in ((psi, "psi"), (low, "psi_low"), (high, "psi_high"))],
        "edges", "ranks", F.when(filled, F.lit(rank_error(k) + step)).alias("rank_error"))


def audit(report: DataFrame, long: DataFrame, ref, window: str, by: Sequence[str] = (), n_bins: int = 10,
          eps: float = 1e-4, group_bound: int | None = None) -> DataFrame:
    """The report beside counts of all rows: ``worst_rank`` (largest error of a rank) and ``counted_psi``.

    One pass over ``long`` (reference window included).  NULL where the report has no PSI.  The report is
    written first: a sketch made a second time has other edges, since KLL draws at random.
    """
    report = materialize(report, "report")
    groups = ["feature", *by]
    edges = report.groupBy(*groups).agg(F.any_value("edges", True).alias("edges"))  # one reference, so all windows agree
    bins = [f"h{i}" for i in range(n_bins)]
    values = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    hist = with_reference(histogram(values, edges, [window, *groups], groups, n_bins, group_bound), window, ref, groups, ["n_binned", *bins])
    both = join_bounded(report, hist.select(window, *groups, "n_binned", "r_n_binned", *bins, *[f"r_{b}" for b in bins]), [window, *groups])
    upto, errors, psi = F.lit(0), [], F.lit(0.0)
    for i, b in enumerate(bins):
        upto = upto + F.col(b)
        if i < n_bins - 1:
            errors.append(F.abs(F.col("ranks")[i] - safe_ratio(upto, F.col("n_binned"))))
        p, q = (F.greatest(safe_ratio(F.col(f"{s}{b}"), F.col(f"{s}n_binned")), F.lit(eps)) for s in ("r_", ""))
        psi = psi + (q - p) * F.ln(q / p)
    given = F.col("psi").isNotNull()
    return both.select(*report.columns, F.when(given, F.greatest(*errors)).alias("worst_rank"), F.when(given, psi).alias("counted_psi"))
