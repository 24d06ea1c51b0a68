"""Column expressions shared by the operators (all JVM-side, no Python UDFs)."""

from .exprs import (
    class_struct,
    edge_rank,
    hash32,
    hash_mille,
    psi_term,
    safe_ratio,
    uniform,
)

__all__ = [
    "class_struct",
    "edge_rank",
    "hash32",
    "hash_mille",
    "psi_term",
    "safe_ratio",
    "uniform",
]
