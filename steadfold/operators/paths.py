"""Cheapest paths to a goal, and the neighbour graph over records they run on.

The graph links records that lie close to each other where records are many, so a path never
crosses a region that holds none.  Its buckets split where they are full: a record looks for
neighbours in cells of its own density, and the number of pairs in a bucket is bounded however many
records share a region.
"""

from __future__ import annotations

import functools
import io
import itertools
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_BOUND, join_bounded, materialize, scratch_path

NODE_LIMIT = float(2**53)  # lattice numbers beyond it are no longer exact
FOLD_EVERY = 8
STEP_ROUNDS = 8  # after so many rounds of one step each, paths known to be long go on block by block
STEP_NODES = 1 << 10  # and at once where a round made more nodes better
BLOCK_NODES = 1 << 15
PIECE = 1 << 22  # bytes of a block's steps in one row


def relax(edges: DataFrame, seeds: DataFrame, keys: Sequence[str], nexts: Sequence[str], max_steps: int | None = None,
          near: Sequence[Column] = (), nodes: DataFrame | None = None) -> tuple[DataFrame, list[int], bool]:
    """Cheapest path of every node to a seed, along ``edges (keys, nexts, w)`` with ``w >= 0``.

    Only nodes whose path became better in the last round send offers, and a round writes only the
    nodes it made better, to the shared folder: a lost executor costs a round at most.  Every
    ``FOLD_EVERY`` rounds what was written is folded to one row per reached node, so a round reads few
    files.  Of equally dear paths the one with fewer steps wins, then the smallest next node.

    Every round is a job whose plan and tasks the driver keeps track of.  With ``near``, columns of the
    ``keys`` by whose order nodes close to each other come close, rounds after the first ``STEP_ROUNDS``, or after
    one that made more than ``STEP_NODES`` nodes better, take all steps inside a block of nodes at once (see
    :func:`_by_blocks`); a step limit is kept step by step.  ``nodes`` may give the keys of all nodes, if they are at hand.

    Returns the reached nodes ``(keys, path_cost, path_steps, nexts)``, how many nodes each round
    made better (the seeds first), and whether rounds were left when ``max_steps`` ended them.
    """
    spark = seeds.sparkSession
    keys, nexts = list(keys), list(nexts)
    value = ["path_cost", "path_steps", *nexts]
    folder = scratch_path(spark, "paths")
    first = seeds.select(*keys, F.lit(0.0).alias("path_cost"), F.lit(0).alias("path_steps"),
                         *[F.lit(None).cast(seeds.schema[k].dataType).alias(n) for k, n in zip(keys, nexts)])
    schema = first.schema

    def read(*names: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{folder}/{name}" for name in names])

    def write(rows: DataFrame, i: int) -> int:
        rows.write.parquet(f"{folder}/{i}")
        written.append(str(i))
        return read(str(i)).count()  # an Observation would stay in the session, and model training could not be sent to tasks

    def folded() -> DataFrame:
        return read(*written).groupBy(*keys).agg(F.min(F.struct(*value)).alias("b")).select(*keys, "b.*")

    def better(i: int) -> DataFrame:
        """Nodes for which an offer of round ``i``'s nodes beats what they have."""
        ahead = read(str(i)).select(*[F.col(k).alias(n) for k, n in zip(keys, nexts)], "path_cost", "path_steps")
        offers = edges.join(_unsent(ahead, lowered[i]), nexts).select(
            *keys, (F.col("path_cost") + F.col("w")).alias("path_cost"), (F.col("path_steps") + 1).alias("path_steps"), *nexts)
        both = offers.select(*keys, *value, F.lit(True).alias("new")).unionByName(
            read(*written).select(*keys, *value, F.lit(False).alias("new")))
        pick = lambda new: F.min(F.when(F.col("new") == new, F.struct(*value)))
        best = both.groupBy(*keys).agg(pick(True).alias("offer"), pick(False).alias("known"))
        return best.where(F.col("offer").isNotNull() & (F.col("known").isNull() | (F.col("offer") < F.col("known")))).select(
            *keys, "offer.*")

    written: list[str] = []
    lowered = [write(first, 0)]
    while lowered[-1] and (max_steps is None or len(lowered) <= max_steps):
        i = len(lowered)
        if near and max_steps is None and (i > STEP_ROUNDS or lowered[-1] > STEP_NODES):
            best, more = _by_blocks(edges, folded(), keys, nexts, near, nodes)
            return best, lowered + more, False
        if i % FOLD_EVERY == 0:
            folded().write.parquet(f"{folder}/to-{i}")
            written[:] = [f"to-{i}"]
        lowered.append(write(better(i - 1), i))
    left = bool(lowered[-1]) and not better(len(lowered) - 1).isEmpty()
    return folded(), lowered, left


def _unsent(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, kept from a broadcast when it has many rows: files are small where values repeat, and Spark would
    decide by their size."""
    return side if rows <= BROADCAST_ROW_BOUND else side.hint("merge")


def _packed(key: tuple, steps: pd.DataFrame) -> pd.DataFrame:
    """The steps of a block by the node they lead to, as arrays in a few rows; ``u < 0`` says that block ``-1 - u`` has a step to ``v``."""
    u, v, w = (steps[c].to_numpy() for c in ("u", "v", "w"))
    seen, order = u < 0, np.argsort(v, kind="stable")
    order = order[~seen[order]]
    ids = np.unique(np.concatenate([u[~seen], v]))
    by, at = np.unique(np.stack([-1 - u[seen], np.searchsorted(ids, v[seen])]), axis=1)
    file = io.BytesIO()
    np.savez(file, ids=ids, start=np.append(np.searchsorted(v[order], ids), len(order)), u=np.searchsorted(ids, u[order]).astype(np.int32),
             w=w[order], seen_by=by.astype(np.int32), seen_at=at.astype(np.int32))
    data = file.getvalue()
    cuts = range(0, len(data), PIECE)
    return pd.DataFrame({"block": [key[0]] * len(cuts), "piece": range(len(cuts)), "data": [data[i : i + PIECE] for i in cuts]})


def _settled(block: int, packed: pd.DataFrame, known: pd.DataFrame, begun: bool) -> pd.DataFrame:
    """All steps inside one block: its nodes that got a better path than the one in ``known``, and copies of them for the blocks that see them.

    A block that has ``begun`` is settled but for the nodes outside; else all its paths are new to the others.
    """
    columns = ["block", "id", "path_cost", "path_steps", "ahead", "own"]
    if packed.empty or known.empty:
        return known.reindex(columns=columns)[:0]
    held = np.load(io.BytesIO(b"".join(packed.sort_values("piece")["data"])))
    ids, start, tail, weight, seen_by, seen_at = (held[c] for c in ("ids", "start", "u", "w", "seen_by", "seen_at"))
    known = known[known["id"].isin(ids)].sort_values(["id", "path_cost", "path_steps", "ahead"]).drop_duplicates("id")
    cost, steps, ahead = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
    at, own = np.searchsorted(ids, known["id"]), known["own"].to_numpy(bool)
    cost[at], steps[at] = known["path_cost"], known["path_steps"]
    ahead[at] = np.where(known["ahead"] < 0, -1, np.searchsorted(ids, known["ahead"]))
    better, told = np.zeros((2, len(ids)), bool)
    told[at[own]] = not begun
    new = at[~own] if begun else at
    while len(new):
        many = start[new + 1] - start[new]
        edge = np.arange(many.sum()) + np.repeat(start[new] - np.cumsum(many) + many, many)
        u, to = tail[edge], np.repeat(new, many)
        c, n = cost[to] + weight[edge], steps[to] + 1
        wins = (c < cost[u]) | (c == cost[u]) & ((n < steps[u]) | (n == steps[u]) & (to < ahead[u]))
        u, to, c, n = u[wins], to[wins], c[wins], n[wins]
        order = np.lexsort((to, n, c, u))
        first = order[np.append(True, u[order][1:] != u[order][:-1])[: len(order)]]
        new = u[first]
        cost[new], steps[new], ahead[new], better[new] = c[first], n[first], to[first], True
    sent = (better | told)[seen_at]
    mine = np.flatnonzero(better)
    node = np.append(mine, seen_at[sent])
    return pd.DataFrame({
        "block": np.append(np.full(len(mine), block, np.int32), seen_by[sent]), "id": ids[node], "path_cost": cost[node],
        "path_steps": steps[node].astype(np.int32), "ahead": np.where(ahead[node] < 0, -1, ids[ahead[node]]),
        "own": np.arange(len(node)) < len(mine)})


def _settling(begun: bool) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda key, packed, known: _settled(key[0], packed, known, begun)


def _by_blocks(edges: DataFrame, found: DataFrame, keys: Sequence[str], nexts: Sequence[str], near: Sequence[Column],
               nodes: DataFrame | None) -> tuple[DataFrame, list[int]]:
    """:func:`relax` from ``found`` on, to the end, with all steps inside a block of nodes in one round.

    Blocks are ranges of the order ``near``, of about ``BLOCK_NODES`` nodes however many share a region.  A
    block takes part in a round when a node outside that its edges lead to became better, so rounds are as many as
    blocks that a path crosses.  A round writes the nodes it made better for their own block and for each block that
    sees them, so the next one reads them by block and joins nothing; the steps of a block are packed once.  The driver
    gets two counts a block.  Nodes are numbered in the order of their keys, so that the smallest next node is as before.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "blocks")
    ends = [nodes.select(*keys)] if nodes is not None else [edges.select(*keys), edges.select(*[F.col(n).alias(k) for k, n in zip(keys, nexts)]), found.select(*keys)]
    every = materialize(functools.reduce(DataFrame.unionByName, ends).distinct(), "path-nodes")
    total = every.count()
    placed = materialize(every.repartitionByRange(-(-total // BLOCK_NODES), *near).withColumn("block", F.spark_partition_id()), "path-blocks")
    nodes = materialize(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()), "path-ids")
    here = _unsent(nodes, total)
    ahead = _unsent(nodes.select(*[F.col(k).alias(n) for k, n in zip(keys, nexts)], F.col("id").alias("ahead"), F.col("block").alias("ahead_block")), total)
    step, seen = F.struct("block", F.col("id").alias("u"), F.col("ahead").alias("v"), "w"), F.struct(
        F.col("ahead_block").alias("block"), (-1 - F.col("block")).cast("bigint").alias("u"), F.col("ahead").alias("v"), F.lit(0.0).alias("w"))
    steps = edges.join(here, list(keys)).join(ahead, list(nexts)).select(
        F.inline(F.when(F.col("block") == F.col("ahead_block"), F.array(step)).otherwise(F.array(step, seen))))
    packed = materialize(steps.groupBy("block").applyInPandas(_packed, "block int, piece int, data binary"), "path-edges")
    first = found.join(here, list(keys)).join(ahead.drop("ahead_block"), list(nexts), "left").select(
        "block", "id", "path_cost", "path_steps", F.coalesce("ahead", F.lit(-1)).alias("ahead"), F.lit(True).alias("own"))
    schema = first.schema
    written: list[str] = []

    def write(rows: DataFrame) -> tuple[int, list[int]]:
        """How many nodes became better, and the blocks that see one of them."""
        name = str(len(lowered))
        rows.write.parquet(f"{folder}/{name}")
        written.append(name)
        counts = read(name).groupBy("block", "own").count().collect()
        return sum(r["count"] for r in counts if r["own"]), sorted({r["block"] for r in counts if not (r["own"] and lowered)})

    def read(*names: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{folder}/{name}" for name in names])

    def folded() -> DataFrame:
        return read(*written).groupBy("block", "id", "own").agg(F.min(F.struct("path_cost", "path_steps", "ahead")).alias("b")).select(
            "block", "id", "b.*", "own")

    lowered: list[int] = []
    _, active = write(first)
    while active:
        taking = F.col("block").isin(active)
        rows = packed.where(taking).groupBy("block").cogroup(read(*written).where(taking).groupBy("block")).applyInPandas(_settling(bool(lowered)), schema)
        lowered.append(0)
        lowered[-1], active = write(rows)
        if len(written) == FOLD_EVERY:
            folded().write.parquet(f"{folder}/to-{len(lowered)}")
            written[:] = [f"to-{len(lowered)}"]
    best = folded().where("own").drop("block", "own").join(nodes.select(*keys, "id"), "id").join(ahead.drop("ahead_block"), "ahead", "left")
    return best.select(*keys, "path_cost", "path_steps", *nexts), lowered if lowered and not lowered[-1] else [*lowered, 0]


# ------------------------------------------------------------------ neighbour graph over records


def _lattice(widths: Mapping[str, float], depth: int) -> dict[str, Column]:
    return {f: F.col(f).cast("double") / F.lit(float(w) / 2**depth) for f, w in widths.items()}


def place_records(records: DataFrame, widths: Mapping[str, float], depth: int, fixed: Sequence[str] = ()) -> DataFrame:
    """The records with their node: ``g`` (values of the fixed features) and ``q_<feature>``.

    A null, infinite or NaN feature, or one beyond the lattice, leaves ``q_...`` NULL.
    """
    group = F.to_json(F.struct(*[F.col(c) for c in fixed])) if fixed else F.lit("{}")
    return records.withColumns({"g": group} | {
        f"q_{f}": F.when(F.abs(x) < NODE_LIMIT, F.floor(x)).cast("bigint") for f, x in _lattice(widths, depth).items()})


def record_nodes(records: DataFrame, widths: Mapping[str, float], depth: int, leaf: int, score: Column,
                 threshold: float, min_share: float, fixed: Sequence[str] = ()) -> DataFrame:
    """Distinct records as nodes, with the cell of a split grid each lies in.

    Cells have ``widths`` at level 0 and half of it at every further level; a cell with more than
    ``leaf`` nodes is split.  Nodes are the cells of level ``depth``, so splitting always ends and
    records that agree to ``width / 2**depth`` are one node, however many they are.  Levels go from
    parents to children, at most ``2**features`` each, so no join meets a full cell.

    Output: ``g, q_<feature>.., n, level, density, dense, goal, factor``.  ``density`` is records of
    the node's cell per level-0 cell, ``dense`` asks for ``min_share`` of all records, ``goal`` reads
    ``score`` at node centres (features by name), ``factor`` is the price of a unit of distance.
    Records without a node (see :func:`place_records`) are left out.
    """
    if leaf < 1 or depth < 0:
        raise ValueError("leaf must be at least 1 and depth at least 0")
    qs, cs = [f"q_{f}" for f in widths], [f"c_{f}" for f in widths]
    placed = place_records(records, widths, depth, fixed)
    nodes = placed.dropna(subset=qs).groupBy("g", *qs).agg(F.count("*").alias("n"))
    at = [F.struct(F.lit(lv).alias("level"), *[F.shiftright(F.col(q), depth - lv).alias(c) for q, c in zip(qs, cs)])
          for lv in range(depth + 1)]
    cells = materialize(
        nodes.select("g", "n", F.inline(F.array(*at))).groupBy("level", "g", *cs).agg(
            F.count("*").alias("nodes"), F.sum("n").alias("n")), "cells")

    def level(lv: int) -> DataFrame:
        return cells.where(F.col("level") == lv).drop("level")

    fits = lambda lv, x: F.when(F.col("nodes") <= leaf, x)
    here = level(0).withColumns({"level": fits(0, F.lit(0)), "held": fits(0, F.col("n"))})
    for lv in range(1, depth + 1):
        up = here.select(F.col("g"), *[F.col(c).alias(f"p_{c}") for c in cs], F.col("level").alias("p_level"), F.col("held").alias("p_held"))
        kids = level(lv).withColumns({f"p_{c}": F.shiftright(F.col(c), 1) for c in cs})
        here = kids.join(up, ["g", *[f"p_{c}" for c in cs]]).select(
            "g", *cs, "nodes", "n", F.coalesce("p_level", fits(lv, F.lit(lv))).alias("level"),
            F.coalesce("p_held", fits(lv, F.col("n"))).alias("held"))
    density = F.col("held") * F.pow(F.lit(2.0), len(cs) * F.col("level"))
    found = materialize(here.select("g", *[F.col(c).alias(q) for c, q in zip(cs, qs)], "n", "level", density.alias("density")), "nodes")
    whole = found.agg(F.sum("n").alias("__all"), F.max("density").alias("__top")).withColumn("__one", F.lit(1))
    centres = {f: (F.col(q) + 0.5) * F.lit(float(w) / 2**depth) for q, (f, w) in zip(qs, widths.items())}
    return join_bounded(found.withColumn("__one", F.lit(1)), whole, ["__one"], rows=1).withColumns(centres).select(
        "g", *qs, "n", "level", "density", (F.col("density") / F.col("__all") >= min_share).alias("dense"),
        (score < threshold).alias("goal"), F.log1p(F.col("__top") / F.col("density")).alias("factor"))


def neighbour_edges(nodes: DataFrame, widths: Mapping[str, float], depth: int,
                    directions: Mapping[str, Sequence[int]]) -> DataFrame:
    """Steps between neighbouring nodes: ``(g, q_.., next_.., w)``.

    Two nodes are neighbours when no feature differs by more than the smaller of their two cells.
    The node of the finer cell probes the cells around its own at that level, where a node of a
    coarser or equal level stands with at most ``leaf - 1`` others, so a bucket holds a bounded number
    of pairs.  A step enters dense nodes only, moves a feature only up or down as ``directions``
    allows (a feature not named may not move), and costs distance times the factor of the node entered.
    Goals need no steps of their own.
    """
    fs = list(widths)
    qs, cs = [f"q_{f}" for f in fs], [f"c_{f}" for f in fs]
    held = ["level", "dense", "goal", "factor"]
    around = [F.struct(*[F.expr(f"shiftright(`{q}`, {depth} - level) + {o}").alias(c) for q, o, c in zip(qs, offsets, cs)])
              for offsets in itertools.product((-1, 0, 1), repeat=len(fs))]
    probe = nodes.select("g", F.struct(*qs, *held).alias("a"), F.col("level").alias("at"), F.inline(F.array(*around)))
    index = nodes.select("g", F.struct(*qs, *held).alias("b"), F.explode(F.sequence("level", F.lit(depth))).alias("at"), *qs).select(
        "g", "b", "at", *[F.expr(f"shiftright(`{q}`, {depth} - at)").alias(c) for q, c in zip(qs, cs)])
    gap = lambda q: F.col(f"b.{q}") - F.col(f"a.{q}")
    near = F.lit(True)
    for q in qs:
        near = near & (F.abs(gap(q)) <= F.expr(f"shiftleft(1L, {depth} - at)"))
    apart = F.lit(False)
    for q in qs:
        apart = apart | (gap(q) != 0)
    square = sum((gap(q).cast("double") * gap(q).cast("double") for q in qs), F.lit(0.0))
    pairs = probe.join(index.hint("merge"), ["g", "at", *cs]).where(near & apart).select(
        "g", "a", "b", (F.sqrt(square) / float(2**depth)).alias("d"))

    def allowed(src: str, dst: str) -> Column:
        ok = F.col(f"{dst}.dense") & ~(F.col(f"{src}.goal") & F.col(f"{src}.dense"))
        for f, q in zip(fs, qs):
            move = F.col(f"{dst}.{q}") - F.col(f"{src}.{q}")
            ways = set(directions.get(f, ()))
            if 1 not in ways:
                ok = ok & (move <= 0)
            if -1 not in ways:
                ok = ok & (move >= 0)
        return ok

    def step(src: str, dst: str, when: Column) -> Column:
        return F.when(when & allowed(src, dst), F.struct(
            *[F.col(f"{src}.{q}").alias(q) for q in qs], *[F.col(f"{dst}.{q}").alias(f"next_{f}") for f, q in zip(fs, qs)],
            (F.col("d") * F.col(f"{dst}.factor")).alias("w")))

    both = F.array(step("a", "b", F.lit(True)), step("b", "a", F.col("b.level") < F.col("a.level")))
    return pairs.select("g", F.explode(both).alias("s")).where(F.col("s").isNotNull()).select(
        "g", "s.*").withColumn("next_g", F.col("g"))


def _interleaved(qs: Sequence[str], bits: int = 24) -> Column:
    """The low ``bits`` bits of all columns, taken in turns from the highest: close values mostly have close results."""
    taken = [F.substring(F.lpad(F.bin(F.col(q)), 64, "0"), 64 - b, 1) for b in range(bits - 1, -1, -1) for q in qs]
    return F.concat(*taken)


def record_graph_paths(nodes: DataFrame, widths: Mapping[str, float], depth: int, directions: Mapping[str, Sequence[int]],
                       max_steps: int | None = None) -> tuple[DataFrame, list[int], bool]:
    """``nodes`` with the cheapest path to a dense goal; also :func:`relax`'s rounds and limit.

    Nodes without a path have a NULL ``path_cost``; an empty table gives an empty one.
    """
    nodes = materialize(nodes, "graph-nodes")
    edges = materialize(neighbour_edges(nodes, widths, depth, directions), "graph-edges")
    keys = ["g", *[f"q_{f}" for f in widths]]
    nexts = ["next_g", *[f"next_{f}" for f in widths]]
    best, lowered, left = relax(edges, nodes.where("goal and dense"), keys, nexts, max_steps, [F.col("g"), _interleaved(keys[1:])], nodes)
    return nodes.join(best.drop("next_g"), keys, "left"), lowered, left


def look_up_records(records: DataFrame, paths: DataFrame, widths: Mapping[str, float], depth: int,
                    fixed: Sequence[str] = (), keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """Every record with its node's columns; records without a node have NULL there."""
    keys = ["g", *[f"q_{f}" for f in widths]]
    return place_records(records, widths, depth, fixed).select(*keep, *keys).join(paths, keys, "left")
