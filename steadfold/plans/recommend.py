"""Counterfactual recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_mille
from ..operators import counterfactual as m
from ..operators import paths as p
from ..session import literal_table
from .registry import query
from .views import cohorts, r, sql_hash

FEATURES = ["o_orderpriority", "o_orderstatus", "c_mktsegment"]
POLICY = [
    ("o_orderpriority", "1-URGENT", "2-HIGH", 1.0, True),
    ("o_orderpriority", "1-URGENT", "3-MEDIUM", 2.5, True),
    ("o_orderpriority", "2-HIGH", "3-MEDIUM", 1.5, True),
    ("o_orderpriority", "2-HIGH", "5-LOW", 4.0, True),
    ("o_orderpriority", "3-MEDIUM", "5-LOW", 2.0, True),
    ("o_orderpriority", "3-MEDIUM", "1-URGENT", 0.5, False),
    ("o_orderstatus", "F", "P", 3.0, True),
    ("o_orderstatus", "P", "O", 2.0, True),
    ("c_mktsegment", "MACHINERY", "BUILDING", 5.0, True),
    ("c_mktsegment", "HOUSEHOLD", "FURNITURE", 2.0, True),
    ("c_mktsegment", "AUTOMOBILE", "BUILDING", 4.0, True),
]
# exact binary fractions, so that sums do not depend on their order
WEIGHTS = {
    ("o_orderpriority", "1-URGENT"): 1.0, ("o_orderpriority", "2-HIGH"): 0.75, ("o_orderpriority", "3-MEDIUM"): 0.25,
    ("o_orderpriority", "4-NOT SPECIFIED"): 0.5, ("o_orderstatus", "F"): 0.5, ("o_orderstatus", "P"): 0.25,
    ("c_mktsegment", "MACHINERY"): 0.5, ("c_mktsegment", "HOUSEHOLD"): 0.375, ("c_mktsegment", "AUTOMOBILE"): 0.25,
}
BIAS, THRESHOLD = 0.125, 1.0
SCHEMA = "feature string, from_value string, to_value string, cost double, feasible boolean"


def records(t):
    return t("orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey", "o_orderpriority", "o_orderstatus").join(
        t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").drop("o_custkey")


def policy(t):
    return literal_table(t.spark, POLICY, SCHEMA)


SQL_RECORDS = f"""rec AS (SELECT o_orderkey AS record_id, o_orderpriority, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
policy(feature, f, t, cost, feasible) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d}e0, {str(e).lower()})" for a, b, c, d, e in POLICY)}),
wt(feature, v, w) AS (VALUES {", ".join(f"('{a}', '{b}', {w}e0)" for (a, b), w in WEIGHTS.items())})"""


def _sql_opts(i: int, f: str) -> str:
    return f"""o{i} AS (SELECT f, t, cost, COALESCE(wn.w, 0e0) - COALESCE(wo.w, 0e0) AS d FROM policy p
  LEFT JOIN wt wn ON wn.feature = p.feature AND wn.v = p.t LEFT JOIN wt wo ON wo.feature = p.feature AND wo.v = p.f
  WHERE p.feature = '{f}' AND feasible
  UNION ALL SELECT v, NULL, 0e0, 0e0 FROM (SELECT DISTINCT {f} AS v FROM rec))"""


SQL_FOUND = SQL_RECORDS + ", " + ", ".join(_sql_opts(i, f) for i, f in enumerate(FEATURES)) + f""",
sc AS (SELECT rec.*, {BIAS}e0 + COALESCE(w0.w, 0e0) + COALESCE(w1.w, 0e0) + COALESCE(w2.w, 0e0) AS score FROM rec
  LEFT JOIN wt w0 ON w0.feature = 'o_orderpriority' AND w0.v = o_orderpriority
  LEFT JOIN wt w1 ON w1.feature = 'o_orderstatus' AND w1.v = o_orderstatus
  LEFT JOIN wt w2 ON w2.feature = 'c_mktsegment' AND w2.v = c_mktsegment),
allc AS (SELECT record_id, score, score + o0.d + o1.d + o2.d AS new_score, o0.cost + o1.cost + o2.cost AS cost,
   CAST((o0.t IS NOT NULL) AS INTEGER) + CAST((o1.t IS NOT NULL) AS INTEGER) + CAST((o2.t IS NOT NULL) AS INTEGER) AS n_changes,
   concat_ws('+', CASE WHEN o0.t IS NOT NULL THEN 'o_orderpriority' END, CASE WHEN o1.t IS NOT NULL THEN 'o_orderstatus' END,
     CASE WHEN o2.t IS NOT NULL THEN 'c_mktsegment' END) AS changed_set,
   concat_ws('; ', 'o_orderpriority: ' || o_orderpriority || ' -> ' || o0.t, 'o_orderstatus: ' || o_orderstatus || ' -> ' || o1.t,
     'c_mktsegment: ' || c_mktsegment || ' -> ' || o2.t) AS changes
  FROM sc JOIN o0 ON o0.f = o_orderpriority JOIN o1 ON o1.f = o_orderstatus JOIN o2 ON o2.f = c_mktsegment WHERE score >= {THRESHOLD}e0),
found AS (SELECT * FROM allc WHERE n_changes BETWEEN 1 AND 2 AND new_score < {THRESHOLD}e0)"""


def found(t):
    return m.counterfactuals(records(t), FEATURES, policy(t), WEIGHTS, BIAS, THRESHOLD, 2, n_policy=len(POLICY))


@query("cf1_feasible_moves", f"""
WITH {SQL_RECORDS}, long AS (SELECT record_id, 'o_orderpriority' AS feature, o_orderpriority AS v FROM rec
  UNION ALL SELECT record_id, 'o_orderstatus', o_orderstatus FROM rec UNION ALL SELECT record_id, 'c_mktsegment', c_mktsegment FROM rec)
SELECT record_id, long.feature, v AS from_value, t AS to_value, cost FROM long JOIN policy p ON p.feature = long.feature AND p.f = v WHERE feasible""")
def cf1(t):
    return m.feasible_moves(records(t), FEATURES, policy(t), n_policy=len(POLICY))


@query("cf2_counterfactuals", f"WITH {SQL_FOUND} SELECT * FROM found")
def cf2(t):
    return found(t)


SQL_TOP = SQL_FOUND + """,
persets AS (SELECT *, row_number() OVER (PARTITION BY record_id, changed_set ORDER BY cost, new_score, changes) AS s FROM found),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY cost, new_score, changes) AS rank FROM persets WHERE s = 1),
best AS (SELECT record_id, score, new_score, cost, n_changes, changed_set, changes, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 2)"""


@query("cf4_top_recommendations", f"WITH {SQL_TOP} SELECT * FROM best")
def cf4(t):
    return m.top_recommendations(found(t), 2)


@query("cf5_expert_review", f"""
WITH {SQL_TOP} SELECT record_id, rank, changes, CASE WHEN {sql_hash("'s1|review|' || record_id")} % 1000 >= 300 THEN 'pending'
  WHEN record_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS review_status FROM best""")
def cf5(t):
    best = m.top_recommendations(found(t), 2)
    reviews = t("orders").where(hash_mille("s1", "review", F.col("o_orderkey")) < 300).select(
        F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("rejected").alias("review_status"))
    return m.attach_review(best, reviews, ["record_id"]).select("record_id", "rank", "changes", "review_status")


# ------------------------------------------------------------------ feasible paths

STEPS = {"l_quantity": 5.0, "l_discount": 0.02, "l_tax": 0.02}
MOVES = {"l_quantity": [-1], "l_discount": [-1, 1], "l_tax": [-1]}
COST = {"l_quantity": 1.0, "l_discount": 0.5, "l_tax": 0.75}
PATH_THRESHOLD, MIN_SHARE = 0.9, 0.001


def path_cells(t):
    score = F.col("l_quantity") / 50 + F.col("l_tax") * 5 + F.abs(F.col("l_discount") - 0.05) * 8
    return m.density_cells(cohorts(t), STEPS, score, PATH_THRESHOLD, MIN_SHARE)


def _sql_steps() -> str:
    out = []
    for f, ds in MOVES.items():
        for d in ds:
            nxt = ", ".join(f"c_{g} + {d if g == f else 0} AS n_{g}" for g in STEPS)
            out.append(f"SELECT c_l_quantity, c_l_discount, c_l_tax, {nxt}, {COST[f]}e0 AS unit FROM cells")
    return " UNION ALL ".join(out)


_KEY = "c_l_quantity, c_l_discount, c_l_tax"
#: Cheapest cost with exactly k steps, for every k up to the number of cells.
SQL_PATHS = f"""RECURSIVE placed AS (SELECT CAST(floor(l_quantity / 5e0) AS INTEGER) AS c_l_quantity, CAST(floor(l_discount / 0.02e0) AS INTEGER) AS c_l_discount,
  CAST(floor(l_tax / 0.02e0) AS INTEGER) AS c_l_tax FROM lineitem),
cnt AS (SELECT {_KEY}, COUNT(*) AS n FROM placed GROUP BY ALL),
cells AS (SELECT *, n / CAST(SUM(n) OVER () AS DOUBLE) AS share, (c_l_quantity + 0.5e0) * 5e0 / 50 + (c_l_tax + 0.5e0) * 0.02e0 * 5
   + abs((c_l_discount + 0.5e0) * 0.02e0 - 0.05e0) * 8 < {PATH_THRESHOLD}e0 AS goal FROM cnt),
edges AS (SELECT s.*, unit * -ln(t.share) AS w FROM ({_sql_steps()}) s
  JOIN cells t ON t.c_l_quantity = n_l_quantity AND t.c_l_discount = n_l_discount AND t.c_l_tax = n_l_tax AND t.share >= {MIN_SHARE}e0),
walk AS (SELECT {_KEY}, 0e0 AS cost, 0 AS steps FROM cells WHERE goal AND share >= {MIN_SHARE}e0
  UNION ALL SELECT e.c_l_quantity, e.c_l_discount, e.c_l_tax, MIN(d.cost + e.w), steps + 1 FROM edges e JOIN walk d
  ON d.c_l_quantity = n_l_quantity AND d.c_l_discount = n_l_discount AND d.c_l_tax = n_l_tax
  WHERE steps < (SELECT COUNT(*) FROM cells) GROUP BY e.c_l_quantity, e.c_l_discount, e.c_l_tax, steps),
best AS (SELECT {_KEY}, MIN(cost) AS cost FROM walk GROUP BY ALL)"""


@query("cf3_feasible_paths", f"""
WITH {SQL_PATHS}
SELECT {_KEY}, n, goal, c.share >= {MIN_SHARE}e0 AS dense, round(d.cost, 6) AS path_cost
FROM cells c LEFT JOIN best d USING ({_KEY})""")
def cf3(t):
    paths = m.feasible_paths(path_cells(t), MOVES, COST)
    return paths.select(*[f"c_{f}" for f in STEPS], "n", "goal", "dense", r("path_cost"))


@query("cf3_record_paths", f"""
WITH {SQL_PATHS}
SELECT round(d.cost, 6) AS path_cost, COUNT(*) AS n_records FROM placed LEFT JOIN best d USING ({_KEY}) GROUP BY ALL""")
def cf3_records(t):
    paths = m.feasible_paths(path_cells(t), MOVES, COST)
    return m.record_paths(cohorts(t), STEPS, paths).groupBy(r("path_cost")).agg(F.count("*").alias("n_records"))




# ------------------------------------------------------------------ paths over the records themselves

# widths are powers of two, so that cells are exact in any engine
GRAPH = {"o_totalprice": 65536.0, "c_acctbal": 1024.0}
GRAPH_DEPTH, GRAPH_LEAF, GRAPH_SHARE, GRAPH_THRESHOLD = 6, 12, 0.0005, 0.5
GRAPH_WAYS = {"o_totalprice": [-1], "c_acctbal": [-1, 1]}


def graph_records(t):
    return t("orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey", "o_totalprice").join(
        t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"), "o_custkey").drop("o_custkey")


def graph_paths(t):
    score = F.col("o_totalprice") / 131072 - F.col("c_acctbal") / 8192
    nodes = p.record_nodes(graph_records(t), GRAPH, GRAPH_DEPTH, GRAPH_LEAF, score, GRAPH_THRESHOLD, GRAPH_SHARE, ["c_mktsegment"])
    return p.record_graph_paths(nodes, GRAPH, GRAPH_DEPTH, GRAPH_WAYS)[0]


def sql_graph_nodes(source: str) -> str:
    """Nodes as ``node(id, g, x, y, lv, rho, dense, goal, factor)``, from all levels counted anew by windows."""
    (wx, wy), fine = GRAPH.values(), 2**GRAPH_DEPTH
    return f"""rec AS (SELECT record_id, c_mktsegment AS g, CAST(floor(o_totalprice / {wx / fine}e0) AS BIGINT) AS x,
   CAST(floor(c_acctbal / {wy / fine}e0) AS BIGINT) AS y FROM ({source})),
pts AS (SELECT g, x, y, COUNT(*) AS n FROM rec WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
lvls AS (SELECT pts.*, l, COUNT(*) OVER cell AS nodes, SUM(n) OVER cell AS held FROM pts, range({GRAPH_DEPTH + 1}) r(l)
  WINDOW cell AS (PARTITION BY g, l, x >> CAST({GRAPH_DEPTH} - l AS INTEGER), y >> CAST({GRAPH_DEPTH} - l AS INTEGER))),
rho AS (SELECT g, x, y, n, l AS lv, CAST(held AS DOUBLE) * pow(2e0, 2 * l) AS rho FROM lvls WHERE nodes <= {GRAPH_LEAF}
  QUALIFY row_number() OVER (PARTITION BY g, x, y ORDER BY l) = 1),
node AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY g, x, y) AS id, rho / SUM(n) OVER () >= {GRAPH_SHARE}e0 AS dense,
   (x + 0.5e0) * {wx / fine}e0 / 131072 - (y + 0.5e0) * {wy / fine}e0 / 8192 < {GRAPH_THRESHOLD}e0 AS goal,
   ln(1e0 + MAX(rho) OVER () / rho) AS factor FROM rho)"""


#: Every pair of nodes of a segment is compared by distance; no cells, no levels of an index.
SQL_GRAPH = """RECURSIVE """ + sql_graph_nodes(
    "SELECT o_orderkey AS record_id, o_totalprice, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey") + f""",
edges AS MATERIALIZED (SELECT a.id AS u, b.id AS v, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) / {2**GRAPH_DEPTH}e0 * b.factor AS w
  FROM node a JOIN node b ON a.g IS NOT DISTINCT FROM b.g AND b.x <= a.x AND b.x >= a.x - (1 << CAST({GRAPH_DEPTH} - greatest(a.lv, b.lv) AS INTEGER))
   AND abs(a.y - b.y) <= (1 << CAST({GRAPH_DEPTH} - greatest(a.lv, b.lv) AS INTEGER)) AND a.id <> b.id AND b.dense),
best(id, cost) USING KEY (id) AS (SELECT id, 0e0 FROM node WHERE goal AND dense
  UNION SELECT e.u, MIN(b.cost + e.w) FROM best b JOIN edges e ON e.v = b.id LEFT JOIN recurring.best k ON k.id = e.u
  GROUP BY e.u, k.cost HAVING k.cost IS NULL OR MIN(b.cost + e.w) < k.cost)"""


@query("cf3_record_graph", f"""
WITH {SQL_GRAPH}
SELECT record_id, CAST(node.lv AS INTEGER) AS level, goal, dense, round(cost, 6) AS path_cost
FROM rec LEFT JOIN node ON rec.g IS NOT DISTINCT FROM node.g AND rec.x = node.x AND rec.y = node.y LEFT JOIN best ON best.id = node.id""")
def cf3_graph(t):
    return p.look_up_records(graph_records(t), graph_paths(t), GRAPH, GRAPH_DEPTH, ["c_mktsegment"]).select(
        "record_id", "level", "goal", "dense", r("path_cost"))
