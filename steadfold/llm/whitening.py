"""Whitening of embeddings with principal components from an exact characteristic polynomial.

1. Entries become integers, so counts, sums and products of all vectors are exact.  A task adds its
   products up in blocks that double precision holds without rounding; Spark adds the tasks' sums.
2. With n vectors, sums S and products G the scatter ``A = n * G - S * S'`` is an integer matrix, and
   the covariance is ``A / n**2``.  Its characteristic polynomial is found modulo as many primes as
   its largest coefficient can need (a bound from the trace), by reduction to Hessenberg form; the
   primes are dealt out to tasks.  Chinese remaindering gives the integer coefficients.
3. All roots are real, so the sign changes of the polynomial moved to t count the roots beyond t with
   their multiplicity.  Bisection on that count isolates the largest roots, and bisection on the sign
   refines them to far beyond double precision.
4. The null space of ``A - root * I`` comes from inverse iteration in decimal arithmetic of 90 digits, on
   as many vectors as the root is multiple.

What reaches the driver is bounded by the dimension: one matrix, one polynomial, the components.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.session import materialize

SCALE, LIMB, ROWS = 1024.0, 20, 4096  # limbs of 20 bits: products of 4,096 rows stay below 2**53
DIGITS = 90
CLOSE = 128  # roots that agree in so many bits count as one
FINE = 192  # bits of a single root


# ------------------------------------------------------------------ exact sums


def whole(values: np.ndarray) -> np.ndarray:
    """``floor(1024 * c)``, held within 2**62 on both sides."""
    return np.clip(np.floor(values * SCALE), -(2.0**62), 2.0**62).astype(np.int64)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of integers, lowest first, that add up to them in steps of 2**20; the last part has the sign."""
    parts = []
    while len(x) and np.abs(x).max() >> LIMB:
        parts.append(x & ((1 << LIMB) - 1))
        x = x >> LIMB
    return [*parts, x]


def products(x: np.ndarray) -> np.ndarray:
    """``x' x`` in Python integers."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for lo in range(0, len(x), ROWS):
        parts = [p.astype(np.float64) for p in limbs(x[lo : lo + ROWS])]
        for a, left in enumerate(parts):
            for b, right in enumerate(parts):
                out += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (a + b))
    return out


def squares(x: np.ndarray) -> list[int]:
    """The sum of squares of every row, exact."""
    if not len(x):
        return []
    if x.dtype == object:
        return (x * x).sum(axis=1).tolist()
    parts, out = limbs(x), 0
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            out = out + ((left * right).sum(axis=1).astype(object) << (LIMB * (a + b)))
    return out.tolist()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(dim: int):
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = whole(_matrix(batch.column(0), dim))
            n += len(x)
            for at, part in enumerate(limbs(x)):
                total += part.sum(axis=0).astype(object) << (LIMB * at)
            gram += products(x)
        if n:
            flat = [n, *total, *gram[upper]]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(flat)), pa.int32()), pa.array([Decimal(int(v) >> 64) for v in flat], kind),
                 pa.array([Decimal(int(v) & (2**64 - 1)) for v in flat], kind)], names=["k", "hi", "lo"])

    return run


def scatter(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """``n``, the sums, and ``n * products - sums * sums'`` of ``floor(1024 * c)`` over all rows of a table of one array column."""
    parts = vectors.mapInArrow(_sums(dim), "k int, hi decimal(38,0), lo decimal(38,0)")
    rows = parts.groupBy("k").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()  # one row per matrix entry
    flat = {r.k: (int(r.hi) << 64) + int(r.lo) for r in rows}
    if not flat:
        return 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    n, total = flat[0], np.array([flat[1 + i] for i in range(dim)], object)
    gram = np.zeros((dim, dim), object)
    for k, (i, j) in enumerate(zip(*np.triu_indices(dim))):
        gram[i, j] = gram[j, i] = flat[1 + dim + k]
    return n, total, n * gram - np.outer(total, total)


# ------------------------------------------------------------------ characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every number below 3 * 10**9."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if n != base and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(count: int) -> list[int]:
    """The largest primes below 2**31."""
    found, n = [], 2**31 - 1
    while len(found) < count:
        if _is_prime(n):
            found.append(n)
        n -= 2
    return found


def hessenberg_polynomials(m: np.ndarray, moduli: np.ndarray) -> np.ndarray:
    """Coefficients, from the constant on, of ``det(x * I - m)`` of each matrix modulo its own prime below 2**31."""
    count, dim, _ = m.shape
    m, p, every = m.copy(), moduli.astype(np.int64), np.arange(count)
    p2, p3 = p[:, None], p[:, None, None]
    for k in range(1, dim - 1):
        below = m[:, k:, k - 1] != 0
        pivot = k + below.argmax(axis=1)
        m[every, k], m[every, pivot] = m[every, pivot], m[every, k]
        m[every, :, k], m[every, :, pivot] = m[every, :, pivot], m[every, :, k]
        inverse = np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(m[:, k, k - 1], p)], np.int64)
        u = m[:, k + 1 :, k - 1] * inverse[:, None] % p2
        m[:, k + 1 :] = (m[:, k + 1 :] - u[:, :, None] * m[:, k, None, :]) % p3
        m[:, :, k] = (m[:, :, k] + (m[:, :, k + 1 :] * u[:, None, :] % p3).sum(axis=2)) % p2
    poly = np.zeros((dim + 1, count, dim + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(1, dim + 1):
        now = -m[:, k - 1, k - 1, None] * poly[k - 1] % p2
        now[:, 1:] += poly[k - 1, :, :-1]
        chain = np.ones(count, np.int64)
        for i in range(1, k):
            chain = chain * m[:, k - i, k - i - 1] % p
            now -= (m[:, k - i - 1, k - 1] * chain % p)[:, None] * poly[k - i - 1] % p2
        poly[k] = now % p2
    return poly[dim]


def polynomial(spark: SparkSession, a: np.ndarray, batch: int = 16) -> list[int]:
    """Coefficients of ``det(x * I - a)`` for an integer matrix without negative eigenvalues; a task holds ``batch`` primes at once."""
    dim, trace = len(a), int(np.trace(a))
    bits = max((math.log2(math.comb(dim, k)) + k * (math.log2(trace) - math.log2(k)) for k in range(1, dim + 1)), default=0.0) if trace else 0.0
    moduli = primes(int(bits + 2) // 30 + 2)
    steps = -(-len(moduli) // batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for step in rows.column(0).to_pylist():
                own = moduli[step * batch : (step + 1) * batch]
                found = hessenberg_polynomials(np.stack([(a % q).astype(np.int64) for q in own]), np.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.range(0, steps, 1, steps).mapInArrow(run, "p long, c array<long>").collect()  # bounded by the dimension
    coefficients, modulus = [0] * (dim + 1), 1
    for row in sorted(rows, key=lambda r: r.p):
        inverse = pow(modulus, -1, row.p)
        coefficients = [c + modulus * ((r - c) * inverse % row.p) for c, r in zip(coefficients, row.c)]
        modulus *= row.p
    return [c - modulus if 2 * c > modulus else c for c in coefficients]


# ------------------------------------------------------------------ roots


def roots_beyond(c: list[int], num: int, k: int) -> int:
    """How many roots of a polynomial with real roots only are above ``num / 2**k`` (``num`` not negative)."""
    if num:  # scale the roots by 2**k / num, then move them by one
        dim, power, scaled = len(c) - 1, 1, []
        for i, x in enumerate(c):
            scaled.append((x * power) << (k * (dim - i)))
            power *= num
        moved = np.array(scaled[::-1], object)
        for last in range(len(c), 1, -1):
            moved[:last] = np.cumsum(moved[:last])
        c = moved.tolist()
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(c: list[int], num: int, k: int) -> int:
    value, shift = 0, 0
    for x in reversed(c):
        value = value * num + (x << shift)
        shift += k
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], most: int) -> list[tuple[int, int, int]]:
    """``(num, k, multiplicity)`` of the largest positive roots ``num / 2**k``, falling, until ``most`` are covered."""
    most = min(most, roots_beyond(c, 0, 0))
    if not most:
        return []
    top = -c[-2]  # the sum of all roots, and none is negative
    out = []

    def within(lo: int, hi: int, k: int, above_lo: int, above_hi: int) -> None:
        """Roots in (lo, hi] / 2**k, the higher half first."""
        while above_hi < most and above_lo > above_hi:
            if above_lo - above_hi == 1:
                right = _sign(c, hi, k)
                while right and (hi - lo) << FINE > hi:
                    lo, hi, k = 2 * lo, 2 * hi, k + 1
                    mid = (lo + hi) >> 1
                    here = _sign(c, mid, k)
                    if here == 0:
                        lo = hi = mid
                    elif here == right:
                        hi = mid
                    else:
                        lo = mid
                out.append((hi, k, 1))
                return
            if (hi - lo) << CLOSE <= hi:
                out.append((lo + hi, k + 1, above_lo - above_hi))
                return
            lo, hi, k = 2 * lo, 2 * hi, k + 1
            mid = (lo + hi) >> 1
            above_mid = roots_beyond(c, mid, k)
            within(mid, hi, k, above_mid, above_hi)
            hi, above_hi = mid, above_mid

    within(0, top, 0, roots_beyond(c, 0, 0), 0)
    return out


# ------------------------------------------------------------------ components


def null_space(a: np.ndarray, root: Decimal, multiplicity: int) -> np.ndarray:
    """Orthonormal rows that span the vectors ``v`` with ``a v = root v``, in decimals."""
    dim = len(a)
    m = np.array([[Decimal(int(x)) for x in row] for row in a], object)
    m[np.arange(dim), np.arange(dim)] -= root
    tiny, order = root.scaleb(20 - DIGITS), np.arange(dim)
    for k in range(dim):
        best = k + int(np.argmax([abs(x) for x in m[k:, k]]))
        m[[k, best]], order[[k, best]] = m[[best, k]], order[[best, k]]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    block = np.array([[Decimal((7919 * (i + 1) * (j + 3) + 104729 * (j + 1) ** 2) % 1009 + 1) for i in range(dim)] for j in range(multiplicity)], object)
    for _ in range(4):
        x = block.T[order]
        for i in range(1, dim):
            x[i] = x[i] - m[i, :i] @ x[:i]
        for i in reversed(range(dim)):
            x[i] = (x[i] - m[i, i + 1 :] @ x[i + 1 :]) / m[i, i] if i + 1 < dim else x[i] / m[i, i]
        done = []
        for v in x.T:
            for _ in range(2):
                v = v / (v @ v).sqrt()
                for u in done:
                    v = v - (u @ v) * u
            done.append(v / (v @ v).sqrt())
        block = np.array(done, object)
    return block


@dataclass
class Whitening:
    """What :func:`fit` found: eigenvalues belong to ``scatter``, which is the covariance times ``n**2``."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray
    values: list[Decimal]
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v / int(np.trace(self.scatter))) for v in self.values]


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null or empty and holds finite entries only, as ``__vec``, an array of doubles.

    All vectors have one length.  Where they do not, the most frequent length counts (the shorter of
    two equally frequent ones) and the others are left out.
    """
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.withColumn("__vec", vec).where(F.col("__vec").isNotNull() & (F.size("__vec") > 0) & finite)
    lengths = rows.groupBy(F.size("__vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    return rows.where(F.size("__vec") == (lengths[0]["dim"] if lengths else 0))


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 8) -> Whitening:
    """Whitening of all usable rows of ``df``; components with the eigenvalue 0 are not among those found."""
    return _fit(usable(df, vec_col), components)


def _fit(rows: DataFrame, components: int) -> Whitening:
    first = rows.select(F.size("__vec")).head()
    if first is None:
        return Whitening(0, np.zeros(0, object), np.zeros((0, 0), object), [], np.zeros((0, 0)))
    n, total, a = scatter(rows.select("__vec"), first[0])
    values, vectors = [], []
    with decimal.localcontext() as context:
        context.prec, context.Emax, context.Emin = DIGITS, decimal.MAX_EMAX, decimal.MIN_EMIN
        for num, k, multiplicity in largest_roots(polynomial(rows.sparkSession, a), components):
            root = Decimal(num) / Decimal(2**k)
            vectors.extend(null_space(a, root, multiplicity))
            values.extend([root] * multiplicity)
    return Whitening(n, total, a, values[:components], np.array(vectors[:components], float).reshape(len(values[:components]), len(a)))


def _projected(model: Whitening, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Deviations ``n * x - S`` and whitened coordinates of a batch."""
    x = whole(_matrix(column, len(model.sums)))
    if len(x) and model.n * int(np.abs(x).max()) + max(abs(s) for s in model.sums) >> 62:
        off = model.n * x.astype(object) - model.sums
    else:
        off = model.n * x - model.sums.astype(np.int64)
    scale = np.array([float(v.sqrt()) for v in model.values])
    return off, off.astype(np.float64) @ model.vectors.T / scale


def _moments(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, 0.0, 0.0
        for batch in batches:
            w = _projected(model, batch.column(0))[1]
            if not len(w):
                continue
            own = w.mean(axis=0)
            step, both = own - mean, n + len(w)
            spread = spread + (w - own).T @ (w - own) + np.outer(step, step) * (n * len(w) / both)
            mean, n = mean + step * (len(w) / both), both
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "spread": spread.reshape(-1).tolist()}],
                                             pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))]))

    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity.

    Each task centres its rows on their own mean; means and spreads of the tasks are then combined.
    """
    k = len(model.values)
    parts = materialize(rows.select("__vec").mapInArrow(_moments(model), "n long, mean array<double>, spread array<double>"), "moments")
    n = F.sum("n")
    mean = parts.agg(*[(F.sum(F.col("n") * F.col("mean")[i]) / n).alias(f"m{i}") for i in range(k)]).head()
    off = [F.col("mean")[i] - float(mean[i]) for i in range(k)]
    cells = [(F.sum(F.col("spread")[i * k + j] + F.col("n") * off[i] * off[j]) / n - float(i == j)).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    return max(abs(x) for x in parts.agg(*cells).head())


def _rows(model: Whitening):
    count = len(model.values)
    explained = np.array(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                off, w = _projected(model, part.column(1))
                each = pa.array(np.repeat(np.arange(part.num_rows), count))
                total = pa.array([Decimal(int(v)) if int(v) < 10**38 else None for v in squares(off)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), part.num_rows)),
                     pa.array(np.full(len(each), model.n)), total.take(each), pa.array(w.reshape(-1)), pa.array(np.tile(explained, part.num_rows))],
                    names=["id", "component", "n", "deviation", "whitened", "explained"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector and component: ``id_col``, ``component`` (from 1, by falling eigenvalue), ``n`` (vectors
    fitted), ``deviation`` (squared distance of n times the vector from the sums, exact, decimal), ``whitened``, ``explained``
    (share of the trace) and ``identity_error``.

    A vector is used when it is not null and holds no null and no non-finite entry; the others have no
    rows.  Entries become ``floor(1024 * c)``; adding one constant to all of them changes no result.
    Rows that share an id, or have none, stay separate and all count in the fit.  Components without
    variance are left out, so a single vector, equal vectors or an empty table give an empty result.
    Equal eigenvalues share a space, and any orthonormal basis of it is right.  A deviation beyond 38
    digits is null.  Other columns are ignored.
    """
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if id_col.lower() in made:
        raise ValueError(f"{id_col} is the name of a result")
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec").select("id", "__vec")
    model = _fit(rows, components)
    kind = rows.schema["id"].dataType.simpleString()
    if not model.values:
        return rows.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in zip(
            made, ("int", "long", "decimal(38,0)", "double", "double", "double"))])
    error = identity_error(rows, model)
    made_rows = rows.mapInArrow(_rows(model), f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double")
    return made_rows.withColumnRenamed("id", id_col).withColumn("identity_error", F.lit(error))
