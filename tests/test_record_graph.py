"""The neighbour graph over records against a comparison of all pairs and plain relaxation."""

from __future__ import annotations

import heapq
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadfold.operators import paths as p

WIDTHS, DEPTH, LEAF, SHARE, LIMIT = {"x": 8.0, "y": 4.0}, 4, 3, 0.002, 9.0
WAYS = {"x": [-1], "y": [-1, 1]}
SCHEMA = "record_id int, x double, y double, kind string"


def records(n, seed):
    """A crowded corner, equal records, thin regions, three kinds of which one is NULL."""
    r = random.Random(seed)
    rows = [(i, r.uniform(0, 40) if i % 3 else r.gauss(20, 0.7), r.uniform(-6, 10) if i % 3 else r.gauss(3, 0.4), r.choice("ab") if i % 7 else None)
            for i in range(n)]
    rows += [(n + i, 20.0, 3.0, "a") for i in range(n // 2)]
    return rows + [(2 * n, None, 1.0, "a"), (2 * n + 1, math.nan, 1.0, "b"), (2 * n + 2, 1.0, math.inf, "b"), (2 * n + 3, -1e300, 1.0, "a")]


def brute(rows):
    fine = 2**DEPTH
    place = {}
    for i, x, y, g in rows:
        if x is not None and y is not None and math.isfinite(x) and math.isfinite(y) and abs(x) < 1e200:
            place[i] = (g, math.floor(x / (8 / fine)), math.floor(y / (4 / fine)))
    n = {}
    for v in place.values():
        n[v] = n.get(v, 0) + 1
    level, rho = {}, {}
    for g, x, y in n:
        for lv in range(DEPTH + 1):
            s = DEPTH - lv
            cell = [v for v in n if v[0] == g and v[1] >> s == x >> s and v[2] >> s == y >> s]
            if len(cell) <= LEAF:
                level[g, x, y], rho[g, x, y] = lv, sum(n[v] for v in cell) * 4.0**lv
                break
    dense = {v: rho[v] / len(place) >= SHARE for v in n}
    goal = {v: (v[1] + 0.5) * 0.5 < LIMIT for v in n}
    top = max(rho.values())
    into = {}
    for a in n:
        for b in n:
            w = 1 << (DEPTH - max(level[a], level[b]))
            if a != b and a[0] == b[0] and dense[b] and 0 <= a[1] - b[1] <= w and abs(a[2] - b[2]) <= w:
                into.setdefault(b, []).append((a, math.hypot(a[1] - b[1], a[2] - b[2]) / fine * math.log1p(top / rho[b])))
    cost = {}
    heap = [(0.0, repr(v), v) for v in n if goal[v] and dense[v]]
    heapq.heapify(heap)
    while heap:
        c, _, v = heapq.heappop(heap)
        if v not in cost:
            cost[v] = c
            for u, w in into.get(v, []):
                if u not in cost:
                    heapq.heappush(heap, (c + w, repr(u), u))
    return {i: (level[v], dense[v], goal[v], cost.get(v)) for i, v in place.items()}


def graph(spark, rows, max_steps=None):
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = p.record_nodes(df, WIDTHS, DEPTH, LEAF, F.col("x"), LIMIT, SHARE, ["kind"])
    found, lowered, left = p.record_graph_paths(nodes, WIDTHS, DEPTH, WAYS, max_steps)
    return p.look_up_records(df, found, WIDTHS, DEPTH, ["kind"]), lowered, left


def test_equals_all_pairs(spark):
    rows = records(260, 5)
    want = brute(rows)
    got, lowered, left = graph(spark, rows)
    seen = {r["record_id"]: r for r in got.collect()}
    assert seen.keys() == {r[0] for r in rows} and not left
    assert lowered[-1] == 0 and sum(lowered) >= len({(r["g"], r["q_x"], r["q_y"]) for r in seen.values() if r["path_cost"] is not None})
    for i, r in seen.items():
        if i not in want:
            assert r["level"] is None and r["path_cost"] is None
            continue
        assert (r["level"], r["dense"], r["goal"]) == want[i][:3]
        assert r["path_cost"] == (None if want[i][3] is None else pytest.approx(want[i][3], abs=1e-9))
    costs = [w[3] for w in want.values()]
    assert any(c is None for c in costs) and any(c and c > 0 for c in costs)
    assert {w[0] for w in want.values()} >= {0, 1, 2}


def test_first_steps_lead_on(spark):
    """Following ``next_...`` from any record, the cost falls to zero at a goal."""
    rows = graph(spark, records(120, 8))[0].where("path_cost IS NOT NULL").collect()
    at = {(r["g"], r["q_x"], r["q_y"]): r for r in rows}
    for r in rows:
        for left in range(r["path_steps"], 0, -1):
            ahead = at[r["g"], r["next_x"], r["next_y"]]
            assert ahead["path_cost"] <= r["path_cost"] and ahead["path_steps"] == left - 1
            r = ahead
        assert r["goal"] and r["dense"] and r["path_cost"] == 0.0


def test_limit_empty_and_wrong(spark):
    rows = records(120, 8)
    lowered = graph(spark, rows)[1]
    useful = len(lowered) - 2  # the last step lowers nothing
    assert useful >= 2
    assert graph(spark, rows, 1)[1:] == (lowered[:2], True)
    assert not graph(spark, rows, useful)[2]
    got, lowered, left = graph(spark, [(1, None, None, None)])
    assert [tuple(r[c] for c in ("record_id", "level", "path_cost")) for r in got.collect()] == [(1, None, None)]
    assert lowered == [0] and not left
    with pytest.raises(ValueError):
        p.record_nodes(spark.createDataFrame(rows, SCHEMA), WIDTHS, DEPTH, 0, F.col("x"), LIMIT, SHARE)


def test_blocks_equal_single_steps(spark, monkeypatch):
    """Rounds by blocks, many of them small, give the rows of rounds that take one step each."""
    rows = records(260, 5)
    want = sorted(map(str, graph(spark, rows, 10**6)[0].collect()))
    monkeypatch.setattr(p, "BLOCK_NODES", 25)
    monkeypatch.setattr(p, "STEP_ROUNDS", 1)
    got, lowered, left = graph(spark, rows)
    assert sorted(map(str, got.collect())) == want and lowered[-1] == 0 and not left


def test_rounds_do_not_grow_with_steps(spark, monkeypatch):
    """A path of 300 steps crosses a few blocks; every step was a job of its own, which filled the driver's memory."""
    monkeypatch.setattr(p, "BLOCK_NODES", 100)
    monkeypatch.setattr(p, "STEP_ROUNDS", 2)
    edges = spark.range(1, 301).selectExpr("id AS k", "id - 1 AS next_k", "0.5D AS w")
    best, lowered, left = p.relax(edges, spark.range(1).selectExpr("id AS k"), ["k"], ["next_k"], near=[F.col("k")])
    assert sorted(map(tuple, best.collect())) == [(i, i / 2, i, i - 1 if i else None) for i in range(301)]
    assert sum(lowered) == 301 and lowered[-1] == 0 and not left and len(lowered) < 15


def test_block_without_edges(spark, monkeypatch):
    """The seed is a block of its own, and no edge begins there."""
    monkeypatch.setattr(p, "BLOCK_NODES", 1)
    monkeypatch.setattr(p, "STEP_ROUNDS", 1)
    edges = spark.range(1, 4).selectExpr("id AS k", "id - 1 AS next_k", "0.5D AS w")
    best, lowered, left = p.relax(edges, spark.range(1).selectExpr("id AS k"), ["k"], ["next_k"], near=[F.col("k")])
    assert sorted(map(tuple, best.collect())) == [(i, i / 2, i, i - 1 if i else None) for i in range(4)]
    assert lowered[-1] == 0 and not left


def test_few_jobs_a_round(spark, monkeypatch):
    """The driver keeps every job's plan and tasks; a round of blocks was ten jobs and a count of two."""
    monkeypatch.setattr(p, "BLOCK_NODES", 20)
    monkeypatch.setattr(p, "STEP_ROUNDS", 0)
    edges = spark.range(1, 301).selectExpr("id AS k", "id - 1 AS next_k", "0.5D AS w")
    sc, jobs = spark.sparkContext, {}
    for length in (40, 300):
        sc.setJobGroup(f"rounds of {length}", "")
        _, lowered, _ = p.relax(edges.where(F.col("k") <= length), spark.range(1).selectExpr("id AS k"), ["k"], ["next_k"], near=[F.col("k")])
        jobs[length] = (len(sc.statusTracker().getJobIdsForGroup(f"rounds of {length}")), len(lowered))
    sc.setLocalProperty("spark.jobGroup.id", None)
    more, rounds = (b - a for a, b in zip(jobs[40], jobs[300]))
    assert rounds > 8 and more <= 6 * rounds


def test_many_equal_seeds_are_not_broadcast(spark, monkeypatch):
    """Their file is small, as their costs are equal, so Spark would send all of them through the driver."""
    n = p.BROADCAST_ROW_BOUND + 20_000
    hints = []
    monkeypatch.setattr(p, "_unsent", lambda side, rows, f=p._unsent: hints.append((rows, f(side, rows))) or hints[-1][1])
    edges = spark.range(n).selectExpr("id + 1 AS k", "id AS next_k", "1D AS w")
    best, lowered, left = p.relax(edges, spark.range(n).selectExpr("id AS k"), ["k"], ["next_k"], max_steps=1)
    assert best.count() == n + 1 and lowered == [n, 1] and not left
    plans = [edges.withColumnRenamed("next_k", "j").join(side.select(F.col("next_k").alias("j")), "j")._jdf.queryExecution().executedPlan().toString() for _, side in hints]
    assert [(rows, "Broadcast" in plan) for (rows, _), plan in zip(hints, plans)] == [(n, False), (1, True)]


def test_packed_block_in_pieces(monkeypatch):
    """A block's steps come in pieces; a settled block starts from the nodes outside only, and tells the blocks that see it."""
    monkeypatch.setattr(p, "PIECE", 64)
    r = random.Random(3)
    links = {(r.randrange(40), r.randrange(46)): r.choice([0.5, 1.0, 2.0]) for _ in range(160)}  # nodes 40 to 45 are block 8's
    rows = [(7, u, v, w) for (u, v), w in links.items() if u != v] + [(7, -1 - 8, 5, 0.0), (7, -1 - 8, 5, 0.0), (7, -1 - 9, 6, 0.0)]
    packed = p._packed((7,), pd.DataFrame(rows, columns=["block", "u", "v", "w"])).sample(frac=1, random_state=1)
    assert len(packed) > 3 and packed["data"].map(len).max() == 64

    def cheapest(seeds):
        cost = dict(seeds)
        for _ in range(46):
            for _, u, v, w in rows[:-3]:
                if v in cost and cost[v] + w < cost.get(u, math.inf):
                    cost[u] = cost[v] + w
        return cost

    columns = ["block", "id", "path_cost", "path_steps", "ahead", "own"]
    start = pd.DataFrame([(7, 0, 0.0, 0, -1, True), (7, 0, 1.0, 0, -1, True)], columns=columns)
    out = p._settled(7, packed, start, False)
    own = out[out["own"]].set_index("id")["path_cost"].to_dict()
    want = cheapest({0: 0.0})
    assert own | {0: 0.0} == {k: v for k, v in want.items() if k < 40} and (out.loc[out["own"], "block"] == 7).all()
    sent = {(a, b): c for a, b, c in out.loc[~out["own"], ["block", "id", "path_cost"]].itertuples(index=False)}
    assert sent == {(b, i): want[i] for b, i in ((8, 5), (9, 6)) if i in want} and sent
    state = pd.concat([start, out[out["own"]]])
    assert p._settled(7, packed, state, True).empty
    outside = pd.DataFrame([(7, 43, 0.0, 2, 99, False)], columns=columns)
    then = p._settled(7, packed, pd.concat([state, outside]), True)
    want = cheapest({0: 0.0, 43: 0.0})
    assert own | then[then["own"]].set_index("id")["path_cost"].to_dict() | {0: 0.0} == {k: v for k, v in want.items() if k < 40}
    assert not then.empty and p._settled(7, packed[:0], state, False).empty and p._settled(7, packed, state[:0], False).empty
