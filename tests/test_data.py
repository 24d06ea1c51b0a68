from __future__ import annotations

import datetime
import heapq
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from steadfold.operators import burden, counterfactual as cf, ingest, labels
from steadfold.operators.scenarios import Scenario, apply_manifest, apply_scenario
from steadfold.schemas import CHILD_RECORD_HIST, CHILD_RECORD_RICH, FEATURE_ROLES, MOVE_POLICY
from steadfold.session import scratch_path
from steadfold.sources import SnapshotSource, align, append_report, read_report, read_snapshots

D = datetime.date


# ------------------------------------------------------------------ ingestion


def test_snapshots_of_two_schemas_in_two_formats(spark, tmp_path):
    narrow = spark.createDataFrame([("a", 2022, D(2022, 6, 1), D(2020, 6, 2), "F", 80.0, 10.0, True, False, False, "Normal", "p1", "m1")], CHILD_RECORD_HIST)
    narrow.drop("snapshot_year").write.csv(str(tmp_path / "2022"), header=True)
    rich = spark.createDataFrame([], CHILD_RECORD_RICH).select("record_id", "sex", "meals_per_day").union(
        spark.createDataFrame([("b", "M", 3)], "record_id string, sex string, meals_per_day int"))
    rich.write.parquet(str(tmp_path / "2026"))
    frames = read_snapshots(spark, [
        SnapshotSource(2022, str(tmp_path / "2022"), CHILD_RECORD_HIST.replace("snapshot_year INT,", ""), "csv", options={"header": "true"}),
        SnapshotSource(2026, str(tmp_path / "2026"), "record_id STRING, sex STRING, meals_per_day INT"),
    ])
    rows = {r["record_id"]: r for r in align(frames).collect()}
    assert (rows["a"]["snapshot_year"], rows["a"]["height_cm"], rows["a"]["meals_per_day"]) == (2022, 80.0, None)
    assert (rows["b"]["snapshot_year"], rows["b"]["height_cm"], rows["b"]["meals_per_day"]) == (2026, None, 3)


def test_curate_keeps_every_row_once(spark):
    df = spark.createDataFrame([(1, " 12.5 ", "F"), (2, "tall", "M"), (3, "", "F"), (4, "-3", "X"), (5, None, "M")], "id int, height string, sex string")
    clean, rejects = ingest.curate(df, {"height": "double"}, {"height range": F.col("height") > 0, "sex domain": F.col("sex").isin("F", "M")})
    assert {r["id"]: r["height"] for r in clean.collect()} == {1: 12.5, 3: None, 5: None}
    assert {r["id"]: (r["height"], r["failed_rules"]) for r in rejects.collect()} == {
        2: ("tall", ["height: not double"]), 4: ("-3", ["height range", "sex domain"])}


@pytest.mark.parametrize("birth, measured, want", [
    (D(2020, 1, 15), D(2021, 1, 14), 11), (D(2020, 1, 15), D(2021, 1, 15), 12), (D(2020, 1, 31), D(2020, 2, 29), 1), (D(2021, 1, 1), D(2020, 1, 1), None)])
def test_age(spark, birth, measured, want):
    df = spark.createDataFrame([(birth, measured)], "birth_date date, measured_on date")
    assert ingest.with_age(df).first()["age_months"] == want


def test_split_is_stable_and_weighted(spark):
    df = spark.range(4000).withColumnRenamed("id", "record_id")
    w = {"reference": 600, "adapt": 250, "verify": 150}
    a = dict(ingest.assign_split(df, "record_id", w, "s").rdd.map(tuple).collect())
    b = dict(ingest.assign_split(df.orderBy(F.rand(1)).repartition(7), "record_id", w, "s").rdd.map(tuple).collect())
    assert a == b
    share = Counter(a.values())
    assert all(abs(share[k] / 4000 - v / 1000) < 0.03 for k, v in w.items())
    with pytest.raises(ValueError):
        ingest.assign_split(df, "record_id", {"a": 500}, "s")


def test_context_repeats_are_not_observations(spark):
    df = spark.createDataFrame([(2022,)] * 300 + [(2023,)] * 200, "year int")
    ctx = spark.createDataFrame([(2022, 5.0), (2023, 7.0)], "year int, cpi double")
    row = ingest.effective_n(ingest.with_context(df, ctx, ["year"]), ["cpi"]).first()
    assert (row["n_rows"], row["n_distinct_context"]) == (500, 2)
    lagged = ingest.with_context(df.distinct(), ctx, ["year"], lag_years=1).orderBy("year").collect()
    assert [r["cpi_lag1"] for r in lagged] == [None, 5.0]


def test_linkage(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 2)], "id string, snapshot_year int")
    assert {r["n_years"]: r["n_ids"] for r in ingest.linkage(df, "id").collect()} == {1: 2, 2: 1}


def test_report_runs_replace_themselves_only(spark):
    root = scratch_path(spark, "reports-test")
    df = lambda n: spark.range(n).withColumn("phm", F.lit("p"))
    append_report(df(3), root, "burden", "r1", ["phm"])
    append_report(df(2), root, "burden", "r2", ["phm"])
    append_report(df(4), root, "burden", "r1", ["phm"])
    assert {r["run_id"]: r["count"] for r in read_report(spark, root, "burden").groupBy("run_id").count().collect()} == {"r1": 4, "r2": 2}
    append_report(spark.range(1).withColumn("phm", F.lit("q")), root, "burden", "r1", ["phm"])
    left = read_report(spark, root, "burden").where("run_id = 'r1'").collect()
    assert [r["phm"] for r in left] == ["q"]  # the partition "p" of the run is gone
    with pytest.raises(ValueError):
        append_report(df(1), root, "unknown", "r1")


# ------------------------------------------------------------------ labels


def test_indicators_overlap_and_marginals(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, False), (None, False, False)], "stunted boolean, wasted boolean, underweight boolean")
    got = {(r["stunted"], r["wasted"], r["underweight"], r["level"]): r["n"] for r in labels.indicator_overlap(df).collect()}
    assert got[True, None, None, 3] == 2      # stunted at all
    assert got[None, None, None, 3] == 1      # not recorded, apart from ...
    assert got[None, None, None, 7] == 3      # ... everyone


def test_abnormal_growth_that_is_no_case(spark):
    df = spark.createDataFrame([(True, False, None, "Normal"), (True, False, None, "SAM"), (True, False, None, None), (False, False, False, "Normal")],
                               "stunted boolean, wasted boolean, underweight boolean, category string")
    got = {r["stunted"]: r for r in labels.label_crosstab(df).collect()}
    assert (got[True]["n"], got[True]["n_Normal"], got[True]["n_SAM"], got[True]["n_abnormal_not_case"]) == (3, 1, 1, 2)
    assert got[False]["n_abnormal_not_case"] == 0


def test_upstream_projection_drops_what_defines_the_target(spark):
    df = spark.createDataFrame([], CHILD_RECORD_RICH)
    cols = labels.select_upstream(df, FEATURE_ROLES, target="category").columns
    assert "height_cm" not in cols and "stunted" not in cols and {"maternal_age", "record_id", "category"} <= set(cols)
    with pytest.raises(ValueError):
        labels.select_upstream(df.withColumn("surprise", F.lit(1)), FEATURE_ROLES)


def test_leakage_by_data_and_by_role(spark):
    rng = random.Random(1)
    rows = [(y, y + rng.random() / 2, rng.random(), rng.random()) for y in (0, 1) for _ in range(100)]
    df = spark.createDataFrame(rows, "y int, height_cm double, maternal_age double, mystery double")
    got = {r["feature"]: r for r in labels.leakage_report(df, "y", ["height_cm", "maternal_age", "mystery"], 0.9, FEATURE_ROLES).collect()}
    assert got["height_cm"]["separability"] == 1.0 and got["height_cm"]["suspect"]
    assert not got["maternal_age"]["suspect"]
    assert got["mystery"]["suspect"]  # no declared role


def test_imputation_uses_the_given_split_only(spark):
    df = spark.createDataFrame([("reference", 1.0), ("reference", 3.0), ("verify", None), ("verify", 100.0)], "split string, x double")
    stats = labels.fit_impute(df.where("split = 'reference'"), ["x"])
    got = [(r["x"], r["x_missing"]) for r in labels.impute(df, stats).where("split = 'verify'").collect()]
    assert sorted(got) == [(2.0, 1), (100.0, 0)]


# ------------------------------------------------------------------ scenarios


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(2000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 10).cast("double").alias("x"),
                                    F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), F.lit("u1").alias("unit"))


def test_scenarios_hit_their_rates_and_repeat_themselves(spark, people):
    s = Scenario("gaps", "q", "missing", ["x"], {"rate": 0.3})
    one = apply_scenario(people, s, "record_id")
    again = apply_scenario(people.repartition(9), s, "record_id")
    assert one.where("x is null").count() == pytest.approx(600, abs=60)
    assert one.exceptAll(again).count() == 0
    other = apply_scenario(people, Scenario("gaps", "q", "missing", ["x"], {"rate": 0.3}, seed="s2"), "record_id")
    assert one.exceptAll(other).count() > 0


def test_prevalence_scenario_copies_get_their_own_ids(spark, people):
    s = Scenario("surge", "p", "prevalence", params={"label": "label", "copies": {"a": 2.5, "b": 0.5}})
    out = apply_scenario(people, s, "record_id")
    n = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert n["a"] == pytest.approx(2500, abs=80) and n["b"] == pytest.approx(500, abs=80)
    assert out.select("record_id").distinct().count() == out.count()


def test_manifest_equals_the_scenarios_one_by_one(spark, people):
    manifest = [
        Scenario("gaps", "q", "missing", ["x"], {"rate": 0.3}), Scenario("noise", "q", "noise", ["x"], {"scale": 2.0}),
        Scenario("mix", "c", "composition", params={"stratum": "label", "keep": {"a": 0.2}}),
        Scenario("surge", "p", "prevalence", params={"label": "label", "copies": {"a": 2.5}}),
        Scenario("lost", "o", "unavailable", ["x"]), Scenario("unit", "o", "unit_missing", ["x"], {"unit_column": "unit", "unit": "u1", "rate": 0.5}),
        Scenario("flip", "k", "concept", params={"label": "label", "remap": {"a": "b"}, "region": "x > 4"}, tier="stretch"),
    ]
    out = apply_manifest(people, manifest, "record_id")
    cols = people.columns
    assert out.where("scenario = 'none'").select(cols).exceptAll(people).count() == 0
    for s in manifest:
        mine, alone = out.where(F.col("scenario") == s.name).select(cols), apply_scenario(people, s, "record_id").select(cols)
        assert mine.count() == alone.count()
        assert mine.exceptAll(alone).count() == 0
    assert {r["wording"] for r in out.select("wording").distinct().collect()} == {"controlled stress testing"}


# ------------------------------------------------------------------ counterfactuals


def test_counterfactuals_against_brute_force(spark):
    rng = random.Random(12)
    dom = {"f": "abc", "g": "xy", "h": "mn"}
    policy = [("f", "a", "b", 1.0, True), ("f", "a", "c", 2.0, True), ("f", "b", "c", 1.5, False), ("g", "x", "y", 1.0, True), ("h", "m", "n", 0.5, True)]
    weights = {("f", "a"): 1.0, ("f", "b"): 0.5, ("g", "x"): 0.5, ("h", "m"): 0.25}
    recs = [(i, *[rng.choice(v) for v in dom.values()]) for i in range(60)]
    df = spark.createDataFrame(recs, "record_id int, f string, g string, h string")
    pol = spark.createDataFrame(policy, MOVE_POLICY)
    got = cf.counterfactuals(df, list(dom), pol, weights, 0.0, 1.0, 2)
    want = Counter()
    for i, *vals in recs:
        now = dict(zip(dom, vals))
        score = sum(weights.get(kv, 0) for kv in now.items())
        if score < 1:
            continue
        options = [[(v, 0.0)] + [(t, c) for f, a, t, c, ok in policy if ok and f == k and a == v] for k, v in now.items()]
        for a in options[0]:
            for b in options[1]:
                for c in options[2]:
                    new = dict(zip(dom, (a[0], b[0], c[0])))
                    changed = [k for k in dom if new[k] != now[k]]
                    ns = sum(weights.get(kv, 0) for kv in new.items())
                    if 1 <= len(changed) <= 2 and ns < 1:
                        want[i, "+".join(changed), ns, a[1] + b[1] + c[1]] += 1
    assert Counter((r["record_id"], r["changed_set"], r["new_score"], r["cost"]) for r in got.collect()) == want
    assert want
    top = cf.top_recommendations(got, 2).collect()
    for rid in {k[0] for k in want}:
        cheapest = {}
        for (i, s, _, cost) in want:
            if i == rid:
                cheapest[s] = min(cost, cheapest.get(s, 99))
        assert [r["cost"] for r in sorted(top, key=lambda r: r["rank"]) if r["record_id"] == rid] == sorted(cheapest.values())[:2]
    reviews = spark.createDataFrame([(top[0]["record_id"], "approved")], "record_id int, review_status string")
    status = {r["record_id"]: r["review_status"] for r in cf.attach_review(cf.top_recommendations(got, 1), reviews, ["record_id"]).collect()}
    assert status.pop(top[0]["record_id"]) == "approved" and set(status.values()) <= {"pending"}


def test_feasible_paths_against_dijkstra(spark):
    rng = random.Random(7)
    pts = [(rng.randrange(6), rng.randrange(6)) for _ in range(400)]
    pts = [p for p in pts if p not in {(2, 2), (2, 3), (3, 2)}] + [(2, 2)]  # a sparse wall
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "record_id int, x double, y double")
    steps, moves, unit = {"x": 1.0, "y": 1.0}, {"x": [-1], "y": [-1, 1]}, {"x": 1.0, "y": 0.5}
    cells = cf.density_cells(df, steps, F.col("x") + F.col("y"), 3.0, 0.01)
    got = {(r["c_x"], r["c_y"]): r for r in cf.feasible_paths(cells, moves, unit, 12).collect()}
    n = Counter(pts)
    dense = {c for c, k in n.items() if k / len(pts) >= 0.01}
    for start in n:
        best, heap = {}, [(0.0, start)]
        found = None
        while heap:
            d, c = heapq.heappop(heap)
            if c in best:
                continue
            best[c] = d
            if c in dense and c[0] + c[1] + 1 < 3:
                found = d
                break
            for axis, ds in (("x", [-1]), ("y", [-1, 1])):
                for s in ds:
                    t = (c[0] + s, c[1]) if axis == "x" else (c[0], c[1] + s)
                    if t in dense:
                        heapq.heappush(heap, (d + unit[axis] * -math.log(n[t] / len(pts)), t))
        row = got[start]
        assert row["path_cost"] == (None if found is None else pytest.approx(found))
        if found:
            nxt = got[row["next_x"], row["next_y"]]
            assert nxt["path_steps"] == row["path_steps"] - 1 and nxt["path_cost"] < row["path_cost"]
    placed = cf.record_paths(df, steps, cf.feasible_paths(cells, moves, unit, 12))
    assert placed.count() == len(pts)


# ------------------------------------------------------------------ burden


def series(spark, **areas):
    return spark.createDataFrame([(a, 2020 + i, v) for a, vs in areas.items() for i, v in enumerate(vs)], "phm string, period int, cases long")


def test_forecast_needs_enough_periods(spark):
    got = {r["phm"]: r for r in burden.forecast(series(spark, a=[10, 20, 30], b=[5, 9], c=[20, 10, 0]), ["phm"], "period", "cases").collect()}
    assert (got["a"]["trend_value"], got["a"]["last_value"], got["a"]["period"]) == (pytest.approx(40), 30, 2023)
    assert (got["b"]["trend_value"], got["b"]["n_periods"]) == (None, 2)
    assert got["c"]["trend_value"] == 0  # counts do not go below zero


def test_rollup_levels_and_holdout(spark):
    t = spark.createDataFrame([("m1", "p1", 2020, "SAM", 3), ("m1", "p2", 2020, "SAM", 4), ("m2", "p3", 2020, "SAM", 5)], "moh string, phm string, period int, status string, cases long")
    got = {(r["moh"], r["phm"], r["level"]): r["cases"] for r in burden.burden_rollup(t, ["moh", "phm"], "period", "status").collect()}
    assert got["m1", None, 1] == 7 and got[None, None, 3] == 12 and got["m2", "p3", 0] == 5
    err = {r["phm"]: r for r in burden.holdout_error(series(spark, a=[10, 20, 30, 45], b=[7]), ["phm"], "period", "cases").collect()}
    assert (err["a"]["trend_error"], err["a"]["last_value_error"]) == (pytest.approx(5), 15)
    assert err["b"]["trend_error"] is None


def test_rising_areas_rank_by_change(spark):
    got = {r["phm"]: (r["change"], r["rank"]) for r in burden.rising(series(spark, a=[1, 5], b=[9, 10], c=[5, 2]), ["phm"], "period", "cases").collect()}
    assert got == {"a": (4, 1), "b": (1, 2), "c": (-3, 3)}
