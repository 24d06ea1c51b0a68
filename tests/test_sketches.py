"""Stored summaries: bounds against plain counts, added windows, merged parts, awkward groups."""

from __future__ import annotations

import math
import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from steadfold.operators import sketches
from steadfold.session import materialize

SCHEMA = "w int, feature string, value double, part int"


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    made = {(w, "even"): [r.random() + 0.1 * w for _ in range(20000)] for w in range(4)}
    made |= {(w, "hot"): [3.0] * 7000 + [r.gauss(w, 1) for _ in range(9000)] + [None] * (100 * w) + [math.nan] * 50 for w in range(4)}
    made |= {(w, "gone"): [1.0, 2.0, 3.0] if w == 0 else [None, None] for w in range(3)}
    made |= {(w, "late"): [None] if w == 0 else [1.0] for w in range(2)}
    return made


@pytest.fixture(scope="module")
def long(spark, values):
    rows = [(w, f, x, i % 5) for (w, f), xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(16)


def test_bounds_hold_against_plain_counts(long, values):
    report = sketches.stored_psi(sketches.summarize(long, "w"), 0, "w")
    rows = sketches.audit(report, long, 0, "w").collect()
    assert {(r.w, r.feature) for r in rows} == {k for k in values if k[0] != 0}
    for r in rows:
        xs = sorted(x for x in values[r.w, r.feature] if x is not None and not math.isnan(x))
        own = sorted(x for x in values[0, r.feature] if x is not None and not math.isnan(x))
        assert r.missing_rate == 1 - len(xs) / len(values[r.w, r.feature]) or math.isclose(r.missing_rate, 1 - len(xs) / r.n)
        if not xs or not own:
            assert (r.psi, r.psi_low, r.psi_high, r.edges, r.ranks, r.worst_rank, r.counted_psi) == (None,) * 7
            continue
        err = sketches.rank_error()
        for i, e in enumerate(r.edges, 1):  # an edge stands for its share of the reference, ties included
            assert bisect_left(own, e) / len(own) - err <= i / 10 <= bisect_right(own, e) / len(own) + err
        off = [abs(k - bisect_right(xs, e) / len(xs)) for e, k in zip(r.edges, r.ranks)]
        assert math.isclose(max(off), r.worst_rank, abs_tol=1e-12) and max(off) <= r.rank_error
        assert r.psi_low <= min(r.psi, r.counted_psi) and max(r.psi, r.counted_psi) <= r.psi_high


def test_a_new_window_needs_only_its_own_rows(long):
    old = materialize(sketches.summarize(long.where("w < 3"), "w"), "summaries")
    new = sketches.summarize(long.where("w = 3"), "w")
    added = sketches.stored_psi(old.unionByName(new), 0, "w").where("w = 3")
    for r in sketches.audit(added, long, 0, "w").collect():
        assert r.psi_low <= r.counted_psi <= r.psi_high and r.worst_rank <= r.rank_error


def test_parts_merge_into_windows(long):
    daily = long.withColumn("day", F.col("w") * 10 + F.col("part"))
    parts = sketches.summarize(daily, "day")
    merged = sketches.merge(parts, "day", F.floor(F.col("day") / 10).cast("int")).withColumnRenamed("day", "w")
    counts = {(r.w, r.feature): (r.n, r.n_missing) for r in merged.collect()}
    assert counts == {(r.w, r.feature): (r.n, r.n_missing) for r in sketches.summarize(long, "w").collect()}
    checked = sketches.audit(sketches.stored_psi(merged, 0, "w"), long, 0, "w").where("psi IS NOT NULL").collect()
    assert len(checked) == 6
    for r in checked:
        assert r.worst_rank <= r.rank_error and r.psi_low <= r.counted_psi <= r.psi_high


def test_without_reference_or_rows(spark, long):
    report = sketches.stored_psi(sketches.summarize(long, "w"), 99, "w")
    assert report.where("psi IS NOT NULL").count() == 0 and report.count() == 13
    assert sketches.stored_psi(sketches.summarize(spark.createDataFrame([], SCHEMA), "w"), 0, "w").count() == 0


def test_error_falls_with_k():
    assert sketches.rank_error(1600) < sketches.rank_error(800) < 0.02 and sketches.rank_error(share=True) < 0.02
