"""Reusable column expressions.

Everything here compiles into whole-stage codegen: hashing for reproducible
splits and stress scenarios, histogram lookup, PSI terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str) -> Column:
    """32-bit hash of the parts joined by ``|`` (strings are literals).

    md5 based so that any SQL engine can reproduce it; it depends on the values
    only, so it is stable under repartitioning, retries and lost executors.
    """
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def hash_mille(*parts: Column | str) -> Column:
    """Hash bucket in 0..999."""
    return F.pmod(hash32(*parts), F.lit(1000)).cast("int")


def uniform(*parts: Column | str) -> Column:
    """Reproducible pseudo-uniform double in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def safe_ratio(num: Column, den: Column) -> Column:
    """Double ratio, NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def psi_term(base: Column, current: Column, eps: float) -> Column:
    """One bin's contribution to the population stability index."""
    p = F.greatest(base, F.lit(float(eps)))
    q = F.greatest(current, F.lit(float(eps)))
    return (q - p) * F.ln(q / p)


def edge_rank(x: str, edges: str, n_edges: int) -> Column:
    """How many of the sorted ``edges`` lie strictly below ``x``; NULL for NULL.

    A balanced CASE tree instead of an array lambda: log2(n) comparisons per row
    and no interpreted higher-order function in the scan stage.
    """

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{x}` > `{edges}`[{mid}] THEN {tree(mid + 1, hi)} ELSE {tree(lo, mid)} END"

    return F.expr(f"CASE WHEN `{x}` IS NULL THEN NULL ELSE {tree(0, n_edges)} END")


def class_struct(probs: str, label: str, classes: Sequence[str]) -> Column:
    """Array of (class, score, y) structs: the one-vs-rest view of a scored row."""
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.col(probs)[F.lit(c)].alias("score"),
                F.when(F.col(label).isNotNull(), (F.col(label) == F.lit(c)).cast("int")).alias("y"),
            )
            for c in classes
        ]
    )
