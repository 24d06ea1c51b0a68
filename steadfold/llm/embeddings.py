"""Embedding near-duplicates with a robust-pruned flat graph over overlapping cluster shards.

1. Vectors are scaled to length 1 in double precision; equal ones of a label become one class.
2. A label is a shard.  While a shard is above ``shard_rows`` and splitting helps, its vectors go to
   pivots drawn from it (a bounded sample per shard, brought to the rows by a join): to the best one
   and to all that are worse by at most ``slack``, so shards overlap where neighbours could part.
3. A shard is worked on in blocks of bounded size; every block gets a flat graph: nearest and some far
   candidates, robust-pruned, with the reversed lists united to them.  Shards that cannot be split,
   such as thousands of near copies, are only more pairs of blocks, each in a task of its own.
4. A range-expanding greedy search starts at the block's medoid: it follows the best ``beam`` vectors,
   and every vector within the range widened by ``margin``.  What it finds is verified in double precision.
5. A pair that meets in several shards counts in the first one they share.  A task returns numbers of
   links and one edge per vector and local component, never pairs.

:func:`audit` measures the recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfold.session import materialize

from .graph import components

SALTS = 32


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles of length 1; null for those that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column(2):
            x = np.array([np.nan if c is None else c for c in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if top > 0:
                x = x / top
                x = x / np.sqrt((x * x).sum())
                out.append((x + 0.0).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "unit"])


def robust_graph(x: np.ndarray, degree: int = 16, near: int = 24, far: int = 16, alpha: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists, as starts and ends: robust-pruned candidates and the lists that point back, united."""
    n = len(x)
    near, far = min(near, n - 1), min(far, n - 1)
    picks = np.random.default_rng(n).integers(0, n, (n, far)) if n > 1 else np.zeros((n, 0), int)
    kept_edges = []
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(lo + 256, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        best = np.argpartition(-sims, max(near - 1, 0), axis=1)[:, :near]
        cand = np.concatenate([best, picks[rows]], axis=1)
        sim = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        away = 1 - sim
        between = 1 - np.einsum("bkd,bjd->bkj", x[cand], x[cand])
        alive, count = np.isfinite(sim), np.zeros(len(rows), int)
        for j in range(cand.shape[1]):
            take = alive[:, j] & (count < degree)
            count += take
            kept_edges.append(np.stack([rows[take], cand[take, j]], 1))
            alive &= ~(take[:, None] & (alpha * between[:, j] <= away))
    edges = np.concatenate(kept_edges) if kept_edges else np.zeros((0, 2), int)
    edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
    return np.searchsorted(edges[:, 0], np.arange(n + 1)), edges[:, 1]


def range_search(queries: np.ndarray, x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], least: float, beam: int = 16) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of queries: place of the first, and the similarities of what was visited (-inf elsewhere)."""
    starts, ends = graph
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    for lo in range(0, len(queries), 128):
        q = queries[lo : lo + 128]
        score = np.full((len(q), len(x)), -np.inf)
        score[:, medoid] = q @ x[medoid]
        done = np.zeros(score.shape, bool)
        while True:
            edge = np.partition(score, -min(beam, len(x)), axis=1)[:, -min(beam, len(x))]
            who, node = np.nonzero(~done & np.isfinite(score) & ((score >= edge[:, None]) | (score >= least)))
            if not len(who):
                break
            done[who, node] = True
            fresh = np.zeros(score.shape, bool)
            degree = starts[node + 1] - starts[node]
            place = np.arange(degree.sum()) + np.repeat(starts[node] - np.cumsum(degree) + degree, degree)
            fresh[np.repeat(who, degree), ends[place]] = True
            who, node = np.nonzero(fresh & ~np.isfinite(score))
            for a in range(0, len(who), 1 << 16):
                w, v = who[a : a + (1 << 16)], node[a : a + (1 << 16)]
                score[w, v] = np.einsum("nd,nd->n", q[w], x[v])
        yield lo, score


def _shard_flags(a: list, b: list) -> tuple:
    """Which shards each side is in, and the numbering of the shards in their order."""
    names = {s: i for i, s in enumerate(sorted({s for own in (*a, *b) for s in own}))}
    left, right = (np.zeros((len(own), len(names)), bool) for own in (a, b))
    for flags, own in ((left, a), (right, b)):
        for i, shards in enumerate(own):
            flags[i, [names[s] for s in shards]] = True
    return left, right, names


def _linked(similarity: float, margin: float, beam: int):
    """One task: the queries of one block searched in another block of the same shard."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        base, query = rows[rows["base"]], rows[~rows["base"]]
        out = pd.DataFrame({"id": query["id"], "n": np.zeros(len(query), np.int64), "root": query["id"]})
        if not len(base) or not len(query):
            return out
        base, query = base.sort_values("id"), query.sort_values("id")
        x, q = (np.stack([np.frombuffer(u, np.float64) for u in side["unit"]]) for side in (base, query))
        left, right, names = _shard_flags([list(s) for s in query["shards"]], [list(s) for s in base["shards"]])
        before = names[shard]  # shards that sort earlier have counted the pairs they share
        q_id, b_id, copies = query["id"].to_numpy(), base["id"].to_numpy(), base["copies"].to_numpy()
        number = np.zeros(len(q), np.int64)
        root = q_id.copy()
        b_root = np.arange(len(x))  # local components, joined through the queries that link them
        q_root = np.full(len(q), -1)

        def top(i: int) -> int:
            while b_root[i] != i:
                b_root[i] = b_root[b_root[i]]
                i = b_root[i]
            return i

        for lo, score in range_search(q, x, robust_graph(x), similarity - margin, beam):
            hit = score >= similarity
            some = slice(lo, lo + len(score))
            fresh = hit & ~(left[some, :before].astype(np.float32) @ right[:, :before].T.astype(np.float32) > 0) if before else hit.copy()
            fresh &= q_id[some][:, None] != b_id[None, :]
            number[some] = fresh @ copies
            for i in np.flatnonzero(hit.any(axis=1)):
                tops = {top(int(j)) for j in np.flatnonzero(hit[i])}
                least = min(tops)
                for t in tops:
                    b_root[t] = least
                q_root[lo + i] = least
        for i in np.flatnonzero(q_root >= 0):
            root[i] = b_id[top(int(q_root[i]))]
        tied = pd.DataFrame({"id": b_id, "n": 0, "root": b_id[[top(i) for i in range(len(x))]]})
        return pd.concat([pd.DataFrame({"id": q_id, "n": number, "root": root}), tied])

    return run


def _to_pivots(slack: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for unit, pivots in zip(rows["unit"], rows["pivots"]):
                cos = np.stack([np.frombuffer(p, np.float64) for p in pivots]) @ np.frombuffer(unit, np.float64)
                found.append(np.flatnonzero(cos >= cos.max() - slack).tolist())
            yield pd.DataFrame({"id": rows["id"], "shard": rows["shard"], "unit": rows["unit"], "copies": rows["copies"], "to": found})

    return run


def _split(rows: DataFrame, shard_rows: int, pivots: int, slack: float, rounds: int) -> DataFrame:
    """``rows`` with shards of at most ``shard_rows`` where splitting is of any use."""
    done = None
    for _ in range(rounds):
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
        big = materialize(sizes.where(F.col("size") > shard_rows), "big")
        small = rows.join(big, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        if big.isEmpty():
            return done
        # A bounded sample: about 4 * pivots rows of a shard by digest, of which the first ones are its pivots.
        drawn = rows.join(big, "shard").where(
            F.pmod(F.xxhash64("shard", "id"), F.col("size")) < 4 * pivots).groupBy("shard").agg(
            F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("shard", "id").alias("d"), "unit"))), 1, pivots).alias("s"))
        drawn = drawn.select("shard", F.col("s.unit").alias("pivots"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        moved = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(drawn, ["shard", "salt"])
        moved = moved.select("id", "shard", "unit", "copies", "pivots").mapInPandas(_to_pivots(slack), "id long, shard string, unit binary, copies long, to array<int>")
        moved = materialize(moved.select("id", "shard", "unit", "copies", F.explode("to").alias("to")), "moved")
        # A shard whose vectors nearly all go to the same pivots is one dense ball: it stays whole.
        parts = moved.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).groupBy("shard").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
        use = materialize(parts.join(big, "shard").where("most < 0.7 * size and all < 8 * size").select("shard"), "use")
        done = done.unionByName(rows.join(big.join(use, "shard", "left_anti"), "shard", "left_semi"))
        rows = moved.join(use, "shard", "left_semi").select("id", F.concat_ws("/", "shard", "to").alias("shard"), "unit", "copies")
    return done.unionByName(rows)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 similarity: float = 0.93, margin: float = 0.05, beam: int = 16, shard_rows: int = 2048, pivots: int = 16,
                 slack: float = 0.08, rounds: int = 12) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked when their labels are equal and not null, their lengths are equal, and
    their cosine is at least ``similarity``.  Vectors that are null, empty, zero, or hold null or
    non-finite components stand alone, as do rows with a null id or label.  Equal vectors are linked;
    rows that share an id are one node.  An empty table gives an empty result; other columns are ignored.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("v"))
    every = materialize(plain.mapInArrow(_units, "id long, label string, unit binary"), "units")
    usable = every.where("id is not null and label is not null and unit is not null")
    classes = materialize(usable.groupBy("label", "unit").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "classes")
    shards = classes.select(F.col("rep").alias("id"), F.concat_ws(":", F.octet_length("unit"), "label").alias("shard"), "unit", "copies")
    shards = materialize(_split(shards, shard_rows, pivots, slack, rounds).distinct(), "shards")
    at = shards.groupBy("id").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    blocks = shards.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("blocks"))
    placed = shards.join(at, "id").join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id", "shard"), F.col("blocks")).cast("int"))
    placed = materialize(placed, "placed")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    base = placed.select("shard", "block", F.explode(others).alias("of"), F.lit(True).alias("base"), "id", "unit", "copies", "shards")
    query = placed.select("shard", F.explode(others).alias("block"), F.col("block").alias("of"), F.lit(False).alias("base"), "id", "unit", "copies", "shards")
    found = base.unionByName(query).groupBy("shard", "block", "of").applyInPandas(
        _linked(similarity, margin, beam), "id long, n long, root long")
    found = materialize(found, "found")
    numbers = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("id <> root").select("id", "root"), "id", "root")

    member = every.join(classes, ["label", "unit"], "left")
    out = member.join(numbers.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep").withColumnRenamed("root", "top"), "rep", "left")
    component = F.coalesce("top", "rep", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          similarity: float = 0.93, queries: int = 200) -> float:
    """Share of the links of a bounded set of vectors (the ``queries`` smallest digests of ids) that were found; 1.0 without links."""
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    units = materialize(plain.mapInArrow(_units, "id long, label string, unit binary").where("id is not null and label is not null and unit is not null"), "units")
    asked = units.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    ids, labels = np.array([r["id"] for r in asked], np.int64), [r["label"] for r in asked]
    xs = [np.frombuffer(r["unit"], np.float64) for r in asked]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, label, unit in zip(rows["id"], rows["label"], rows["unit"]):
                v = np.frombuffer(unit, np.float64)
                hit = [int(j) for j, m, x in zip(ids, labels, xs) if m == label and j != i and len(x) == len(v) and x @ v >= similarity]
                if hit:
                    yield pd.DataFrame({"id": hit})

    true = units.mapInPandas(count, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    both = true.join(found.select(F.col(id_col).alias("id"), "n_links"), "id").agg(
        F.sum("links"), F.sum(F.least("links", "n_links"))).first()
    return both[1] / both[0] if both[0] else 1.0
