from __future__ import annotations

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from steadfold.operators import prefix, shift


def frame(spark, rows, schema="window_id string, feature string, value double"):
    return spark.createDataFrame(rows, schema)


def windows(spark, **values):
    return frame(spark, [(w, "f", None if v is None else float(v)) for w, vs in values.items() for v in vs])


def psi_rows(spark, long, **kw):
    edges = shift.fit_edges(long.where("window_id = 'ref'"), **kw)
    return {r["window_id"]: r for r in shift.psi(long, edges, "ref").collect()}


def test_identical_windows_do_not_shift(spark):
    vals = [random.Random(1).gauss(0, 1) for _ in range(500)]
    long = windows(spark, ref=vals, cur=vals)
    assert psi_rows(spark, long)["cur"]["psi"] == pytest.approx(0)
    d = shift.cdf_distance(long, ["ref", "cur"], "ref").first()
    assert (d["ks"], d["w1"]) == (0, 0)


def test_disjoint_windows(spark):
    d = shift.cdf_distance(windows(spark, ref=[1, 2], cur=[3, 4]), ["ref", "cur"], "ref").first()
    assert d["ks"] == pytest.approx(1)
    assert d["w1"] == pytest.approx(2)


def test_psi_with_an_empty_bin_is_finite_and_equals_the_formula(spark):
    ref, cur, eps = list(range(100)), [5] * 50 + [95] * 50, 1e-4
    got = psi_rows(spark, windows(spark, ref=ref, cur=cur))["cur"]["psi"]
    edges = [9.9 * i for i in range(1, 10)]
    shares = []
    for side in (ref, cur):
        counts = [0] * 10
        for v in side:
            counts[bisect.bisect_left(edges, v)] += 1
        shares.append([max(c / len(side), eps) for c in counts])
    want = sum((q - p) * math.log(q / p) for p, q in zip(*shares))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_edges_come_from_the_reference_only(spark, method):
    a = windows(spark, ref=range(100), cur=range(100))
    b = windows(spark, ref=range(100), cur=range(1000, 1100))
    get = lambda d: shift.fit_edges(d.where("window_id = 'ref'"), method=method).first()["edges"]
    assert get(a) == get(b)
    assert shift.fit_edges(a, method=method).first()["edge_method"] == method


def test_all_null_feature_has_no_psi(spark):
    row = psi_rows(spark, windows(spark, ref=range(50), cur=[None] * 20))["cur"]
    assert row["missing_rate"] == 1 and row["psi"] is None and row["n"] == 20


def test_one_value_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    ref = [7.0] * 400 + [rng.uniform(0, 20) for _ in range(800)]
    cur = [7.0] * 100 + [rng.uniform(0, 25) for _ in range(700)]
    d = shift.cdf_distance(windows(spark, ref=ref, cur=cur), ["ref", "cur"], "ref", n_buckets=8).first()
    xs = sorted(set(ref + cur))
    sr, sc = sorted(ref), sorted(cur)
    gaps = [abs(bisect.bisect_right(sr, x) / len(sr) - bisect.bisect_right(sc, x) / len(sc)) for x in xs]
    assert d["ks"] == pytest.approx(max(gaps))
    assert d["w1"] == pytest.approx(sum(g * (b - a) for g, a, b in zip(gaps, xs, xs[1:])))


@pytest.mark.parametrize("n_buckets", [2, 16, 64])
def test_prefix_sums_do_not_depend_on_buckets_or_partitions(spark, n_buckets):
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(200)), rng.randrange(3)) for g in ("a", "b", None) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, w int").repartition(5)
    counts = prefix.distinct_counts(df, ["g"], "x", {"w": F.col("w")})
    got = {(r["g"], r["x"]): (r["cum_w"], r["tot_w"], r["next_x"]) for r in prefix.prefix_sums(counts, ["g"], "x", ["w"], n_buckets).collect()}
    for g in ("a", "b", None):
        xs = sorted({x for h, x, _ in rows if h == g})
        total = sum(w for h, _, w in rows if h == g)
        for i, x in enumerate(xs):
            cum = sum(w for h, y, w in rows if h == g and y <= x)
            assert got[(g, x)] == (cum, total, xs[i + 1] if i + 1 < len(xs) else None)


def test_exact_quantiles_equal_the_percentile_aggregate(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([("a", rng.gauss(0, 5)) for _ in range(333)] + [("b", float(i % 3)) for i in range(50)], "g string, x double")
    probs = [0.1, 0.25, 0.5, 0.9]
    counts = prefix.distinct_counts(df, ["g"], "x", {"n": F.lit(1)})
    got = {r["g"]: r["edges"] for r in prefix.exact_quantiles(counts, ["g"], "x", "n", probs).collect()}
    for r in df.groupBy("g").agg(F.percentile("x", probs).alias("p")).collect():
        assert got[r["g"]] == pytest.approx(r["p"])


def test_bucket_count_must_be_a_power_of_two(spark):
    counts = spark.createDataFrame([("a", 1.0, 1)], "g string, x double, w long")
    with pytest.raises(ValueError):
        prefix.prefix_sums(counts, ["g"], "x", ["w"], 12)


def test_new_and_lost_categories_count(spark):
    long = frame(spark, [("ref", "f", c) for c in "aab"] + [("cur", "f", c) for c in "bbc"] + [("cur", "f", None)],
                 "window_id string, feature string, value string")
    row = shift.psi_categorical(long, ["ref", "cur"], "ref").first()
    assert row["n_categories"] == 4
    p = {"a": 2 / 3, "b": 1 / 3, "c": 1e-4, None: 1e-4}
    q = {"a": 1e-4, "b": 0.5, "c": 0.25, None: 0.25}
    assert row["psi"] == pytest.approx(sum((q[c] - p[c]) * math.log(q[c] / p[c]) for c in p))


def test_availability_names_absent_and_empty_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "window_id int, a double, b double")
    got = {(r["window_id"], r["feature"], r["reason"]) for r in shift.availability(df, ["a", "b", "c"]).collect()}
    assert got == {(2, "a", "all null"), (1, "b", "all null"), (2, "b", "all null"), (1, "c", "column absent"), (2, "c", "column absent")}


def test_duplicates_and_rules(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (1, "x", -1.0), (1, "y", None)], "window_id int, id string, v double")
    got = {r["indicator"]: r["n_bad"] for r in shift.dq_indicators(df, ["id"], {"negative": F.col("v") < 0}).collect()}
    assert got == {"duplicate_id": 1, "negative": 1}


def test_input_drift_alone_is_never_concept_shift(spark):
    ev = spark.createDataFrame(
        [("a", 0.9, 0.0, 0.5, 3), ("b", 0.9, 0.0, 0.5, 500), ("c", 0.9, 0.0, 0.0, 500), ("d", 0.0, None, None, 0), ("e", 0.0, 0.0, 0.0, 500), ("f", 0.0, 0.9, 0.0, 500)],
        "window_id string, max_psi double, label_psi double, concept_gap double, n_labelled int")
    got = {r["window_id"]: r for r in shift.classify_shift(ev, 0.2, 0.1, 0.1, 100).collect()}
    assert got["a"]["verdict"] == "covariate, outcome undetermined" and got["a"]["concept_shift"] is None
    assert [got[w]["verdict"] for w in "bcdef"] == ["concept", "covariate", "undetermined", "none", "label"]


@pytest.mark.parametrize("method", ["exact", "approx"])
def test_annual_shift_skips_years_that_cannot_be_compared(spark, method):
    rows = [(2022, float(i)) for i in range(50)] + [(2023, None)] * 20 + [(2024, float(i)) for i in range(50)] + [(2025, float(i)) for i in range(25, 75)]
    got = shift.annual_shift(spark.createDataFrame(rows, "snapshot_year int, x double"), ["x"], edge_method=method).collect()
    assert [(r["prev_year"], r["year"]) for r in got] == [(2024, 2025)]
    assert got[0]["psi"] > 0.5
    assert (got[0]["n_prev"], got[0]["n"]) == (50, 50)


def test_concept_evidence_sees_a_changed_outcome_at_equal_scores(spark):
    rows = [("ref", 0.5, i % 2) for i in range(100)] + [("cur", 0.5, 1) for _ in range(40)] + [("cur", 0.5, None)] * 10
    row = shift.concept_evidence(spark.createDataFrame(rows, "window_id string, score double, y int"), "ref").first()
    assert (row["n_labelled"], row["n_comparable"]) == (40, 40)
    assert row["concept_gap"] == pytest.approx(0.5)


def test_range_check_keeps_unobserved_and_unbounded_features(spark):
    long = spark.createDataFrame(
        [(1, "a", 5.0), (1, "a", 99.0), (2, "a", None), (1, "b", 1.0)], "window_id int, feature string, value double")
    bounds = spark.createDataFrame([("a", 0.0, 10.0)], "feature string, lo double, hi double")
    got = {(r["window_id"], r["feature"]): (r["n"], r["n_out"], r["out_rate"], r["no_bounds"])
           for r in shift.out_of_range(long, bounds).collect()}
    assert got == {(1, "a"): (2, 1, 0.5, False), (2, "a"): (0, 0, None, False), (1, "b"): (1, None, None, True)}
