"""Shift monitoring: did the data change between windows?

The monitors read a *long* table ``(window, feature, value[, by...])`` so that one
job covers all features and all windows; the reference window fixes the bin edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edge_rank, psi_term, safe_ratio
from ..session import join_bounded
from .brackets import bracket_quantiles
from .prefix import distinct_counts, exact_quantiles, prefix_sums

MISSING = "(missing)"


def to_long(df: DataFrame, features: Sequence[str], window: str, by: Sequence[str] = (),
            windows: Sequence | None = None) -> DataFrame:
    """Unpivot numeric features: one row per (row, feature).

    ``windows`` keeps only the windows named; filtering here, before the rows fan out, is
    what lets the filter reach the scan.
    """
    ids = [window, *by]
    if windows is not None:
        df = df.where(F.col(window).isin(list(windows)))
    return unpivot(df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]), ids, features)


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``DataFrame.unpivot`` with re-aliased id columns.

    With plain id columns the expanded rows carry their input's attributes, and two readers
    of the same long table are then planned as different scans instead of one shared one.
    """
    return df.unpivot([F.col(i).alias(i) for i in ids], list(features), "feature", "value")


def window_values(df: DataFrame, window: str, most: int = 1000) -> list:
    """The windows present, for operators that need their list.

    Windows are years, scenarios or model versions; a column with more than ``most`` values
    is not a window column, and that is an error rather than a longer list.  NULL is no window.
    """
    found = [r[0] for r in df.where(F.col(window).isNotNull()).select(window).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{window} has more than {most} values")
    return sorted(found)


def to_long_categorical(df: DataFrame, features: Sequence[str], window: str,
                        by: Sequence[str] = ()) -> DataFrame:
    ids = [window, *by]
    return unpivot(df.select(*ids, *[F.col(f).cast("string").alias(f) for f in features]), ids, features)


# --------------------------------------------------------------------------- PSI


def fit_edges(long: DataFrame, groups: Sequence[str] = ("feature",), n_bins: int = 10,
              method: str = "exact", group_bound: int | None = None) -> DataFrame:
    """Interior bin edges per group from the rows given (pass the reference window only).

    ``exact`` interpolates quantiles by rank; ``approx`` uses a mergeable sketch, which
    needs no shuffle of values and is the choice for continuous features at scale; ``bracket``
    gives the exact ones by a few passes that shuffle bins only (see :mod:`.brackets`).
    The method is recorded with the edges.
    """
    probs = [i / n_bins for i in range(1, n_bins)]
    if method == "approx":
        edges = (
            long.where(F.col("value").isNotNull())
            .groupBy(*groups)
            .agg(F.percentile_approx("value", probs).alias("edges"))
        )
    elif method == "exact":
        counts = distinct_counts(long, groups, "value", {"n": F.lit(1)})
        edges = exact_quantiles(counts, groups, "value", "n", probs, group_bound=group_bound)
    elif method == "bracket":
        edges = bracket_quantiles(long, groups, "value", probs, group_bound=group_bound)[0]
    else:
        raise ValueError(f"unknown edge method {method!r}")
    return edges.withColumn("edge_method", F.lit(method))


def histogram(long: DataFrame, edges: DataFrame, keys: Sequence[str], edge_keys: Sequence[str],
              n_bins: int = 10, group_bound: int | None = None) -> DataFrame:
    """``(keys, n_rows, n_missing, h0..h{n_bins-1}, n_binned)``: NULLs counted apart.

    Rows are combined map-side on (keys, bin) before the shuffle, so what crosses the
    network is bins, not rows.
    """
    binned = join_bounded(long, edges.select(*edge_keys, "edges"), edge_keys, "left", rows=group_bound).select(
        *keys,
        F.when(F.col("value").isNull(), F.lit(-1))
        .when(F.col("edges").isNull(), F.lit(-2))
        .otherwise(edge_rank("value", "edges", n_bins - 1))
        .alias("bin"),
    )
    return _spread(binned.groupBy(*keys, "bin").agg(F.count("*").alias("n")), keys, n_bins)


def _spread(counts: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    """Bin counts (-1 missing, -2 no edges) to one row per key."""
    def total(cond: str, name: str) -> Column:
        return F.expr(f"coalesce(sum(CASE WHEN bin {cond} THEN n END), 0) AS {name}")

    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        total("= -1", "n_missing"),
        *[total(f"= {i}", f"h{i}") for i in range(n_bins)],
        total(">= 0", "n_binned"),
    )


def _hist_psi(n_bins: int, ref_prefix: str, cur_prefix: str, eps: float) -> Column:
    """PSI of two histograms lying side by side in one row; NULL when either is empty."""
    base, cur = f"{ref_prefix}n_binned", f"{cur_prefix}n_binned"
    share = lambda prefix, i, total: f"greatest({prefix}h{i} / {total}, {float(eps)!r}D)"
    terms = [(share(ref_prefix, i, base), share(cur_prefix, i, cur)) for i in range(n_bins)]
    body = " + ".join(f"({q} - {p}) * ln({q} / {p})" for p, q in terms)
    return F.expr(f"CASE WHEN {base} > 0 AND {cur} > 0 THEN {body} END")


def psi(long: DataFrame, edges: DataFrame, ref, window: str = "window_id", by: Sequence[str] = (),
        n_bins: int = 10, eps: float = 1e-4, group_bound: int | None = None) -> DataFrame:
    """PSI and missingness of every window against the reference window.

    Output ``(window, feature, by, n, missing_rate, missing_change, psi)``; PSI is NULL
    when a window has no observed value.
    """
    groups = ["feature", *by]
    hist = histogram(long, edges, [window, *groups], groups, n_bins, group_bound)
    miss = safe_ratio(F.col("n_missing"), F.col("n_rows"))
    return with_reference(hist, window, ref, groups, ["n_rows", "n_missing", "n_binned", *[f"h{i}" for i in range(n_bins)]]).where(
        F.col(window) != F.lit(ref)
    ).select(
        window,
        *groups,
        F.col("n_rows").alias("n"),
        miss.alias("missing_rate"),
        (miss - safe_ratio(F.col("r_n_missing"), F.col("r_n_rows"))).alias("missing_change"),
        _hist_psi(n_bins, "r_", "", eps).alias("psi"),
    )


def with_reference(table: DataFrame, window: str, ref, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Put the reference window's ``columns`` (as ``r_...``) next to every window's own.

    ``table`` is an aggregate, one row per (window, groups).  A window function rather than
    a self-join: joining would send the two filters down to two scans of the data.
    """
    own = Window.partitionBy(*groups)
    base = F.max(F.when(F.col(window) == F.lit(ref), F.struct(*columns))).over(own)
    return table.withColumn("__r", base).selectExpr("*", *[f"__r.{c} AS r_{c}" for c in columns]).drop("__r")


def psi_categorical(long: DataFrame, windows: Sequence, ref, window: str = "window_id",
                    by: Sequence[str] = (), eps: float = 1e-4) -> DataFrame:
    """PSI over the union of the categories seen in either window; NULL is a category.

    Output ``(window, feature, by, n_categories, psi)``.
    """
    groups = ["feature", *by]
    wide = (
        long.withColumn("value", F.coalesce("value", F.lit(MISSING)))
        .groupBy(*groups, "value", window)
        .agg(F.count("*").alias("n"))
        .groupBy(*groups, "value")
        .agg(*[F.coalesce(F.sum(F.when(F.col(window) == F.lit(w), F.col("n"))), F.lit(0)).alias(f"c{i}")
               for i, w in enumerate(windows)])
    )
    # one totals row per group, not a window over the categories: a feature with very
    # many categories must not sit in one task
    totals = wide.groupBy(*groups).agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(windows))])
    r = list(windows).index(ref)
    stacked = join_bounded(wide, totals, groups).select(
        *groups,
        F.inline(F.array(*[
            F.struct(
                F.lit(w).alias(window),
                F.col(f"c{i}").alias("c"), F.col(f"t{i}").alias("t"),
                F.col(f"c{r}").alias("rc"), F.col(f"t{r}").alias("rt"),
            )
            for i, w in enumerate(windows) if i != r
        ])),
    )
    p, q = safe_ratio(F.col("rc"), F.col("rt")), safe_ratio(F.col("c"), F.col("t"))
    return (
        stacked.where((F.col("c") > 0) | (F.col("rc") > 0))
        .groupBy(window, *groups)
        .agg(
            F.count("*").alias("n_categories"),
            F.sum(F.when(p.isNotNull() & q.isNotNull(), psi_term(p, q, eps))).alias("psi"),
        )
    )


# ------------------------------------------------------------------------ KS / W1


def cdf_distance(long: DataFrame, windows: Sequence, ref, window: str = "window_id",
                 by: Sequence[str] = (), n_buckets: int | None = None,
                 group_bound: int | None = None) -> DataFrame:
    """Two-sample KS statistic and Wasserstein-1 distance of every window to the reference.

    All windows share one set of distinct values and one pair of prefix-sum passes.
    Output ``(window, feature, by, n_ref, n_cur, ks, w1)``.
    """
    groups = ["feature", *by]
    names = [f"w{i}" for i in range(len(windows))]
    counts = distinct_counts(
        long, groups, "value", {n: (F.col(window) == F.lit(w)).cast("int") for n, w in zip(names, windows)},
    ).where(F.greatest(*names) > 0)
    cdf = prefix_sums(counts, groups, "value", names, n_buckets, group_bound)
    r = names[list(windows).index(ref)]
    step = F.coalesce(F.col("next_x") - F.col("value"), F.lit(0.0))
    aggs = []
    for n in names:
        gap = F.abs(safe_ratio(F.col(f"cum_{n}"), F.col(f"tot_{n}")) - safe_ratio(F.col(f"cum_{r}"), F.col(f"tot_{r}")))
        aggs += [F.max(gap).alias(f"ks_{n}"), F.sum(gap * step).alias(f"d_{n}"), F.max(f"tot_{n}").alias(f"n_{n}")]
    wide = cdf.groupBy(*groups).agg(*aggs)
    return wide.select(
        *groups,
        F.inline(F.array(*[
            F.struct(
                F.lit(w).alias(window), F.col(f"n_{r}").alias("n_ref"), F.col(f"n_{n}").alias("n_cur"),
                F.col(f"ks_{n}").alias("ks"), F.col(f"d_{n}").alias("w1"),
            )
            for n, w in zip(names, windows) if n != r
        ])),
    )


def ks(long: DataFrame, windows: Sequence, ref, **kw) -> DataFrame:
    return cdf_distance(long, windows, ref, **kw).drop("w1")


def wasserstein1(long: DataFrame, windows: Sequence, ref, **kw) -> DataFrame:
    return cdf_distance(long, windows, ref, **kw).drop("ks")


# ------------------------------------------------------ missingness, range, quality


def missingness(df: DataFrame, features: Sequence[str], ref, window: str = "window_id",
                by: Sequence[str] = ()) -> DataFrame:
    """Missing rate per window and feature in one pass, with the change to the reference."""
    keys = [window, *by]
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f).isNull()).alias(f) for f in features],
    )
    table = wide.unpivot([*keys, "n"], list(features), "feature", "n_missing").withColumn(
        "missing_rate", safe_ratio(F.col("n_missing"), F.col("n"))
    )
    return with_reference(table, window, ref, [*by, "feature"], ["missing_rate"]).select(
        *keys, "feature", "n", "n_missing", "missing_rate",
        (F.col("missing_rate") - F.col("r_missing_rate")).alias("missing_change"),
    )


def out_of_range(long: DataFrame, bounds: DataFrame, window: str = "window_id",
                 by: Sequence[str] = (), n_bounds: int | None = None) -> DataFrame:
    """Share of observed values outside ``[lo, hi]`` per window and feature.

    A feature never observed in a window has ``n`` 0 and no rate; one without bounds has
    ``no_bounds`` and neither ``n_out`` nor a rate.
    """
    joined = join_bounded(long, bounds.withColumn("__bounded", F.lit(True)), ["feature"], "left", rows=n_bounds)
    outside = ~F.col("value").between(F.col("lo"), F.col("hi"))
    return joined.groupBy(window, *by, "feature").agg(
        F.count("value").alias("n"),
        F.max("__bounded").isNull().alias("no_bounds"),
        F.count_if(outside).alias("n_out"),
    ).withColumn("n_out", F.when(~F.col("no_bounds"), F.col("n_out"))).withColumn(
        "out_rate", safe_ratio(F.col("n_out"), F.col("n")))


def duplicate_ids(df: DataFrame, record_id: Sequence[str], window: str = "window_id") -> DataFrame:
    """Ids that occur more than once inside a window, and the surplus rows they cause."""
    per_id = df.groupBy(window, *record_id).agg(F.count("*").alias("n"))
    return per_id.groupBy(window).agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_ids"),
        F.sum(F.col("n") - 1).alias("n_surplus_rows"),
    )


def dq_indicators(df: DataFrame, record_id: Sequence[str], rules: Mapping[str, Column],
                  window: str = "window_id") -> DataFrame:
    """Duplicate ids plus one violation rate per named rule (a rule is TRUE when violated).

    Rule counts travel with the per-id counts, so rows are read once.
    """
    per_id = df.groupBy(window, *record_id).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.coalesce(r, F.lit(False))).alias(f"rule_{k}") for k, r in rules.items()],
    )
    wide = per_id.groupBy(window).agg(
        F.sum(F.col("n") - 1).alias("surplus"), F.sum("n").alias("n"), *[F.sum(f"rule_{k}").alias(f"rule_{k}") for k in rules])
    return wide.select(
        window,
        "n",
        F.inline(F.array(
            F.struct(F.lit("duplicate_id").alias("indicator"), F.col("surplus").alias("n_bad")),
            *[F.struct(F.lit(k).alias("indicator"), F.col(f"rule_{k}").alias("n_bad")) for k in rules],
        )),
    ).withColumn("bad_rate", safe_ratio(F.col("n_bad"), F.col("n")))


def availability(df: DataFrame, expected: Sequence[str], window: str = "window_id") -> DataFrame:
    """Expected features that a window lacks: column absent, or NULL in every row."""
    present = [f for f in expected if f in df.columns]
    counts = df.groupBy(window).agg(*[F.count(f).alias(f) for f in present], F.count("*").alias("__rows"))
    windows = counts.select(window, F.explode(F.array(*[F.lit(f) for f in expected])).alias("feature"))
    if not present:
        return windows.withColumn("reason", F.lit("column absent"))
    observed = counts.unpivot([window], present, "feature", "n").where(F.col("n") > 0).drop("n")
    return windows.join(observed, [window, "feature"], "left_anti").select(
        window, "feature",
        F.when(F.col("feature").isin(present), "all null").otherwise("column absent").alias("reason"))


# -------------------------------------------------------- predictions and outcomes


def class_share(df: DataFrame, column: str, windows: Sequence, ref, window: str = "window_id",
                eps: float = 1e-4) -> DataFrame:
    """Class shares per window with the difference to the reference and each PSI term."""
    wide = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class"), window).agg(
        F.count("*").alias("n")
    ).groupBy("class").agg(*[
        F.coalesce(F.sum(F.when(F.col(window) == F.lit(w), F.col("n"))), F.lit(0)).alias(f"c{i}")
        for i, w in enumerate(windows)
    ])
    totals = wide.agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(windows))]).withColumn("__one", F.lit(1))
    r = list(windows).index(ref)
    stacked = join_bounded(wide.withColumn("__one", F.lit(1)), totals, ["__one"], rows=1).select(
        "class",
        F.inline(F.array(*[
            F.struct(F.lit(w).alias(window), F.col(f"c{i}").alias("n"),
                     safe_ratio(F.col(f"c{i}"), F.col(f"t{i}")).alias("share"),
                     safe_ratio(F.col(f"c{r}"), F.col(f"t{r}")).alias("ref_share"))
            for i, w in enumerate(windows) if i != r
        ])),
    )
    return stacked.select(
        window, "class", "n", "share", (F.col("share") - F.col("ref_share")).alias("share_change"),
        F.when(F.col("share").isNotNull() & F.col("ref_share").isNotNull(),
               psi_term(F.col("ref_share"), F.col("share"), eps)).alias("psi_term"),
    )


def label_shift(labels: DataFrame, windows: Sequence, ref, label: str = "label",
                window: str = "window_id", eps: float = 1e-4) -> DataFrame:
    """Prevalence change P(Y): class shares, largest absolute change and PSI per window."""
    shares = class_share(labels, label, windows, ref, window, eps)
    return shares.groupBy(window).agg(
        F.sum("n").alias("n_labels"),
        F.max(F.abs("share_change")).alias("max_share_change"),
        F.sum("psi_term").alias("psi"),
    )


def prediction_shift(preds: DataFrame, windows: Sequence, ref, score: str = "score",
                     predicted: str = "predicted", window: str = "window_id", n_bins: int = 10,
                     eps: float = 1e-4, edge_method: str = "exact") -> DataFrame:
    """Change of the model's output: score PSI and predicted-class PSI per window."""
    scores = preds.select(window, F.lit("score").alias("feature"), F.col(score).cast("double").alias("value"))
    edges = fit_edges(scores.where(F.col(window) == F.lit(ref)), n_bins=n_bins, method=edge_method, group_bound=1)
    of_score = psi(scores, edges, ref, window, n_bins=n_bins, eps=eps, group_bound=1).select(
        window, F.lit("score").alias("signal"), "psi"
    )
    of_class = label_shift(preds, windows, ref, predicted, window, eps).select(
        window, F.lit("predicted_class").alias("signal"), "psi"
    )
    return of_score.unionByName(of_class)


def concept_evidence(scored: DataFrame, ref, score: str = "score", y: str = "y",
                     window: str = "window_id", n_bins: int = 10) -> DataFrame:
    """Change of the observed outcome rate at equal score, weighted by current volume.

    Needs outcome labels: unlabelled rows take no part and ``n_labelled`` says how many did.
    """
    bins = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    rates = scored.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(window, bins.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")
    )
    gap = F.abs(safe_ratio(F.col("pos"), F.col("n")) - safe_ratio(F.col("r_pos"), F.col("r_n")))
    comparable = F.when(F.col("r_n").isNotNull(), F.col("n"))
    return with_reference(rates, window, ref, ["bin"], ["n", "pos"]).where(F.col(window) != F.lit(ref)).groupBy(window).agg(
        F.sum("n").alias("n_labelled"),
        F.coalesce(F.sum(comparable), F.lit(0)).alias("n_comparable"),
        safe_ratio(F.sum(gap * F.col("n")), F.sum(comparable)).alias("concept_gap"),
    )


def classify_shift(evidence: DataFrame, psi_limit: float, label_limit: float, concept_limit: float,
                   min_labels: int) -> DataFrame:
    """Name the kind of shift from ``(max_psi, label_psi, concept_gap, n_labelled)``.

    Input drift alone is never called concept shift: without enough labels the concept
    question stays open, and the verdict says so.
    """
    covariate = F.coalesce(F.col("max_psi") > psi_limit, F.lit(False))
    enough = F.coalesce(F.col("n_labelled"), F.lit(0)) >= min_labels
    label = enough & F.coalesce(F.col("label_psi") > label_limit, F.lit(False))
    concept = enough & F.coalesce(F.col("concept_gap") > concept_limit, F.lit(False))
    return evidence.withColumns({
        "covariate_shift": covariate,
        "label_shift": F.when(enough, label),
        "concept_shift": F.when(enough, concept),
        "verdict": F.when(concept, "concept")
        .when(label, "label")
        .when(covariate & enough, "covariate")
        .when(covariate, "covariate, outcome undetermined")
        .when(~enough, "undetermined")
        .otherwise("none"),
    })


# ------------------------------------------------------------------ annual comparison


def annual_shift(df: DataFrame, features: Sequence[str], year: str = "snapshot_year",
                 n_bins: int = 10, eps: float = 1e-4, edge_method: str = "exact",
                 year_bound: int = 100) -> DataFrame:
    """PSI of each year against the year before it, on features observed in both.

    A row is binned twice, by its own year's edges (as the base of the next year) and by the
    previous year's edges (as the current side); rows are counted per pair of bins, so the
    two histograms come from one pass.
    """
    bound = len(features) * year_bound
    long = to_long(df, features, year)
    if edge_method == "exact":
        # exact edges need the distinct values anyway: the histograms read the same counts.
        # The guard looks at n so that it stays above the aggregate and both readers share it.
        rows = long.groupBy("feature", year, "value").agg(F.count("*").alias("n"))
        known = rows.where(F.when(F.col("value").isNull(), F.lit(0)).otherwise(F.col("n")) > 0)
        fitted = exact_quantiles(known, ["feature", year], "value", "n", [i / n_bins for i in range(1, n_bins)],
                                 group_bound=bound)
    else:
        rows = long.withColumn("n", F.lit(1).cast("bigint"))
        fitted = fit_edges(long, ["feature", year], n_bins, edge_method, group_bound=bound)
    role = lambda v: F.max(F.when(F.col("role") == v, F.col("edges")))
    pair = fitted.select("feature", "edges", F.inline(F.array(
        F.struct(F.col(year).alias("edge_year"), F.lit("own").alias("role")),
        F.struct((F.col(year) + 1).alias("edge_year"), F.lit("prev").alias("role")),
    ))).groupBy("feature", F.col("edge_year").alias(year)).agg(role("own").alias("own"), role("prev").alias("prev"))

    def bin_by(edges: str) -> Column:
        return F.when(F.col("value").isNull(), -1).when(F.col(edges).isNull(), -2).otherwise(
            edge_rank("value", edges, n_bins - 1))

    counts = join_bounded(rows, pair, ["feature", year], "left", rows=bound).groupBy(
        "feature", year, bin_by("own").alias("b"), bin_by("prev").alias("c")).agg(F.sum("n").alias("n"))
    sides = counts.select("feature", "n", F.inline(F.array(
        F.struct(F.col(year).alias("edge_year"), F.lit("base").alias("side"), F.col("b").alias("bin")),
        F.struct((F.col(year) - 1).alias("edge_year"), F.lit("cur").alias("side"), F.col("c").alias("bin")),
    )))
    hist = _spread(sides, ["feature", "edge_year", "side"], n_bins)
    cols = ["n_rows", "n_missing", "n_binned", *[f"h{i}" for i in range(n_bins)]]
    side = lambda v: F.max(F.when(F.col("side") == v, F.struct(*cols)))
    pairs = hist.groupBy("feature", "edge_year").agg(side("base").alias("b"), side("cur").alias("c")).select(
        "feature", "edge_year", "c.*", *[F.col("b")[c].alias(f"r_{c}") for c in cols])
    # comparable only where both years hold observed values
    return (
        pairs.where((F.col("n_rows") > F.col("n_missing")) & (F.col("r_n_rows") > F.col("r_n_missing")))
        .select(
            "feature",
            F.col("edge_year").alias("prev_year"),
            (F.col("edge_year") + 1).alias("year"),
            F.col("r_n_rows").alias("n_prev"),
            F.col("n_rows").alias("n"),
            _hist_psi(n_bins, "r_", "", eps).alias("psi"),
        )
    )
