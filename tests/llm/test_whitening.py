"""Whitening against a floating-point eigensolver, exact small cases, and awkward rows."""

import decimal
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
from steadfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def expected(vectors):
    x = np.floor(1024.0 * np.asarray(vectors, np.float64)).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    deviation = [sum(int(c) ** 2 for c in row) for row in n * x.astype(object) - total]
    centred = x - total / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    keep = np.argsort(-values)[:8]
    return n, deviation, values[keep], values.sum(), centred @ vecs[:, keep] / np.sqrt(values[keep])


def check(rows, ids, vectors):
    n, deviation, values, trace, whitened = expected(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * 8
    own = np.array([[got[i, k + 1].whitened for k in range(8)] for i in ids])
    own *= np.sign((own * whitened).sum(axis=0))
    assert np.abs(own - whitened).max() < 1e-6
    for at, i in enumerate(ids):
        r = got[i, 3]
        assert (r.n, int(r.deviation)) == (n, deviation[at]) and abs(r.explained / (values[2] / trace) - 1) < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = driver.queries()["op13_whitening"](spark, sf_dir).collect()
    check(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=12) * (1 + i % 3)], "clash") for i in range(200)]
    good += [(200, [float(c) for c in rng.normal(size=12) * 1e3], "far")]
    bad = [(300, None, None), (301, [None] * 12, "x"), (302, [float("nan")] + [0.0] * 11, "x"), (303, [float("-inf")] * 12, "x"), (304, [], "x"), (305, [1.0], "x")]
    frame = spark.createDataFrame(good + bad, SCHEMA).repartition(5)
    check(whitening.whiten(frame).collect(), [r[0] for r in good], np.array([r[1] for r in good], np.float32))
    twice = whitening.whiten(frame.unionByName(frame.withColumn("vec_id", F.lit(None).cast("long")))).collect()
    assert len(twice) == 2 * 8 * len(good) and {r.n for r in twice} == {2 * len(good)}
    for rows in ([], bad[:3], good[:1], [good[0]] * 5):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    few = whitening.whiten(spark.createDataFrame(good[:3], SCHEMA)).collect()
    assert {r.component for r in few} == {1, 2} and few[0].identity_error < 1e-9
    with pytest.raises(ValueError):
        whitening.whiten(frame, id_col="component")


def test_equal_eigenvalues(spark):
    """Two directions of the same variance share a space; coordinates in it are still uncorrelated."""
    points = [[s * c if i == j else 0 for j in range(3)] for i, c in enumerate((5, 5, 3)) for s in (1, -1)]
    rows = [(i, [c / 1024.0 for c in p], "") for i, p in enumerate(points)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>, c string"))
    assert all(abs(v - w) < Decimal("1e-30") for v, w in zip(model.values, (300, 300, 108), strict=True))
    assert np.abs(model.vectors @ model.vectors.T - np.eye(3)).max() < 1e-14
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, c string")).first().identity_error < 1e-12


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 7).flatmap(lambda d: st.lists(st.lists(st.integers(-9, 9), min_size=d, max_size=d), min_size=d, max_size=d)))
def test_polynomials_modulo_primes(rows):
    """Against the method of Faddeev and LeVerrier in integers, singular matrices included."""
    a = np.array(rows, object)
    dim, m, c = len(a), np.zeros((len(a), len(a)), object), [1]
    for k in range(1, dim + 1):
        m = a @ m + c[-1] * np.eye(dim, dtype=int).astype(object)
        c.append(-int(np.trace(a @ m)) // k)
    moduli = whitening.primes(3)
    got = whitening.hessenberg_polynomials(np.stack([(a % q).astype(np.int64) for q in moduli]), np.array(moduli))
    assert got.tolist() == [[x % q for x in reversed(c)] for q in moduli]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=9), st.integers(1, 9))
def test_roots(roots, most):
    c = [1]
    for r in roots:
        c = [0, *c]
        for i in range(len(c) - 1):
            c[i] -= r * c[i + 1]
    with decimal.localcontext() as context:
        context.prec = 80
        got = [(Decimal(num) / 2**k, m) for num, k, m in whitening.largest_roots(c, most)]
    flat = [r for r, m in got for _ in range(m)]
    want = sorted((r for r in roots if r), reverse=True)
    assert len(flat) >= min(most, len(want)) and all(abs(a - b) < Decimal("1e-30") for a, b in zip(flat, want))
    assert len(flat) <= len(want)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=20))
def test_exact_products(rows):
    x = np.array(rows, np.int64)
    exact = x.astype(object)
    assert (whitening.products(x) == exact.T @ exact).all()
    assert whitening.squares(x) == (exact * exact).sum(axis=1).tolist()
