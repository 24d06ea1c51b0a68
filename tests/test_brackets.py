"""Quantiles by narrowing brackets against plain interpolation over sorted values."""

from __future__ import annotations

import math
import random

import pytest

from steadfold.operators.brackets import bracket_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def plain(values):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    out = []
    for p in PROBS:
        at = p * (len(v) - 1)
        a, b = v[math.floor(at)], v[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


@pytest.mark.parametrize("bins", [16, 1024])
def test_equals_sorted(spark, bins):
    r = random.Random(bins)
    groups = {
        "even": [r.random() for _ in range(400)],
        "hot": [3.0] * 300 + [r.gauss(0, 1) for _ in range(150)],
        "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(60)],
        "ends": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1e-323],
        "one": [7.5], "few": [1.0, 2.0], "holes": [None, math.nan, 4.0, None, 6.0], None: [float(i % 13) for i in range(100)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("none", math.nan)]
    r.shuffle(rows)
    found, passes = bracket_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", PROBS, bins=bins, group_bound=10)
    got = {row["g"]: row["edges"] for row in found.collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        if g != "ends":
            assert got[g] == pytest.approx(plain(xs), rel=1e-12, abs=0)
    assert got["ends"][0] == -1.7e308 and got["ends"][-1] == 1.7e308
    assert passes <= (10 if bins == 1024 else 40)


def test_empty(spark):
    found, passes = bracket_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", PROBS)
    assert found.collect() == [] and passes == 0
    with pytest.raises(ValueError):
        bracket_quantiles(found, ["g"], "edges", PROBS, bins=1)
