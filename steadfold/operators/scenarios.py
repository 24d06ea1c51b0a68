"""Reproducible shift scenarios for controlled stress testing.

Controlled stress testing is designed to evaluate maintenance behaviour under plausible
distribution shifts; it is a simulation, not deployment evidence.

A scenario is reduced to an :class:`Effect`: new expressions for some columns and, for
scenarios that change who is in the data, a number of copies per row.  Every draw hashes
``seed | scenario | column | id``, so no scenario needs a shuffle and any run, executor or
SQL engine produces the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uniform

WORDING = "controlled stress testing"


@dataclass(frozen=True)
class Scenario:
    """One manifest line.

    ``kind`` and its ``params``:
    missing(rate), noise(scale), corrupt(rate, factor), composition(stratum, keep),
    prevalence(label, copies), unavailable(), unit_missing(unit_column, unit, rate),
    procedure(step), concept(label, remap, region).
    """

    name: str
    category: str
    kind: str
    columns: Sequence[str] = ()
    params: Mapping[str, object] = field(default_factory=dict)
    seed: str = "s1"
    tier: str = "core"


@dataclass(frozen=True)
class Effect:
    columns: dict[str, Column] = field(default_factory=dict)
    copies: Column | None = None


def _draw(s: Scenario, column: str, record_id: str) -> Column:
    return uniform(s.seed, s.name, column, F.col(record_id))


def _lookup(column: str, table: Mapping[str, float], default: float) -> Column:
    """Literal per-value rates; the table is a handful of strata or classes."""
    out: Column = F.lit(float(default))
    for value, rate in table.items():
        out = F.when(F.col(column).eqNullSafe(F.lit(value)), F.lit(float(rate))).otherwise(out)
    return out


def _stochastic_copies(rate: Column, u: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (u < rate - whole).cast("int")).cast("int")


def effect(s: Scenario, df: DataFrame, record_id: str) -> Effect:
    p = s.params
    cols = list(s.columns)
    if s.kind == "missing":
        return Effect({c: F.when(_draw(s, c, record_id) >= p["rate"], F.col(c)) for c in cols})
    if s.kind == "noise":
        return Effect({c: F.col(c) + F.lit(float(p["scale"])) * (_draw(s, c, record_id) - 0.5) for c in cols})
    if s.kind == "corrupt":
        return Effect({
            c: F.when(_draw(s, c, record_id) < p["rate"], F.col(c) * F.lit(float(p["factor"]))).otherwise(F.col(c))
            for c in cols
        })
    if s.kind == "composition":
        rate = _lookup(p["stratum"], p["keep"], 1.0)
        return Effect(copies=(_draw(s, "keep", record_id) < rate).cast("int"))
    if s.kind == "prevalence":
        rate = _lookup(p["label"], p["copies"], 1.0)
        return Effect(copies=_stochastic_copies(rate, _draw(s, "copies", record_id)))
    if s.kind == "unavailable":
        return Effect({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})
    if s.kind == "unit_missing":
        hit = F.col(p["unit_column"]).eqNullSafe(F.lit(p["unit"]))
        return Effect({c: F.when(~(hit & (_draw(s, c, record_id) < p["rate"])), F.col(c)) for c in cols})
    if s.kind == "procedure":
        step = F.lit(float(p["step"]))
        return Effect({c: F.floor(F.col(c) / step + 0.5) * step for c in cols})
    if s.kind == "concept":
        region, label = p["region"], p["label"]
        inside = region(df) if callable(region) else F.expr(region)
        new = F.col(label)
        for old, to in p["remap"].items():
            new = F.when(F.col(label) == F.lit(old), F.lit(to)).otherwise(new)
        return Effect({label: F.when(F.coalesce(inside, F.lit(False)), new).otherwise(F.col(label))})
    raise ValueError(f"unknown scenario kind {s.kind!r}")


def apply_scenario(df: DataFrame, s: Scenario, record_id: str) -> DataFrame:
    """The stressed table.  Extra copies of a row get the derived id ``id#k``."""
    e = effect(s, df, record_id)
    out = df
    if e.copies is not None:
        out = _multiply(out.withColumn("__n", e.copies), record_id)
    return out.withColumns(e.columns) if e.columns else out


def _multiply(df: DataFrame, record_id: str) -> DataFrame:
    grown = df.where(F.col("__n") > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    rid = F.when(F.col("__k") == 1, F.col(record_id).cast("string")).otherwise(
        F.concat_ws("#", F.col(record_id), F.col("__k"))
    )
    return grown.withColumn(record_id, rid).drop("__n", "__k")


def apply_manifest(df: DataFrame, manifest: Sequence[Scenario], record_id: str,
                   baseline: str | None = "none") -> DataFrame:
    """All scenarios in one scan: ``(scenario, category, tier, wording, record_id, ...)``.

    Rows are fanned out by scenario name inside the stage that reads them; ``baseline`` is
    the untouched data under its own name.
    """
    effects = {s.name: effect(s, df, record_id) for s in manifest}
    tags = [(s.name, s.category, s.tier) for s in manifest]
    if baseline:
        tags.insert(0, (baseline, "baseline", "core"))
    scenario = F.col("scenario")
    fan = df.select(
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("category"), F.lit(t).alias("tier"))
            for n, c, t in tags
        ])),
        F.lit(WORDING).alias("wording"),
        "*",
    )
    copies: Column = F.lit(1)
    columns: dict[str, Column] = {}
    for name, e in effects.items():
        if e.copies is not None:
            copies = F.when(scenario == name, e.copies).otherwise(copies)
        for c, expr in e.columns.items():
            columns[c] = F.when(scenario == name, expr).otherwise(columns.get(c, F.col(c)))
    # draws hash the original id, so columns are rewritten before copies get derived ids
    return _multiply(fan.withColumns({**columns, "__n": copies}), record_id)
