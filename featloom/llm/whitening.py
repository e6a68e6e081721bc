"""Whitening of embeddings: principal components of the covariance by FEAST contour integration.

1. Entries become integers (``floor(64 * c) + 1000000``).  One Spark pass adds up the
   count and the sums, exactly; a second one adds the products of the centred
   vectors ``(n * x - S) / n``, each task sending one d x d matrix.
2. The covariance (d x d, whatever the number of rows) is reduced to tridiagonal
   form once.  The signs of the pivots of ``T - s I`` count the eigenvalues below
   ``s`` (inertia), and bisection on the counts cuts the wanted end of the spectrum
   into intervals at gaps.
3. Each interval is a Spark task of its own: a Gauss-Legendre quadrature of
   ``(z I - V)^-1 Y`` along a circle through the interval's ends projects a random
   block onto its eigenvectors, Rayleigh-Ritz extracts them, and this is repeated
   until the residuals are at rounding level.  The number of pairs found must equal
   the inertia count of the interval, else the block is enlarged and, in the end,
   an error is raised; so none is missed.
4. A last Rayleigh-Ritz over all intervals makes the vectors orthogonal across
   borders.  Every row is projected, and a pass adds up the covariance of the
   result.

Rows: a null vector or one with a null, NaN or infinite entry is dropped, and so is
one whose length is not the most frequent one (ties: the greatest).  Repeated rows
count each.  Eigenvalues below ``RANK * d`` of the largest one are rounding noise of
a covariance of lesser rank: these components are left out.  An empty table, and one
of equal vectors only, gives no rows.  An entry too large for an integer of 53 bits
raises an error.  The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues wanted in an interval, unless they are too close to be cut apart.
SLICE = 8
NODES = 12
#: Eigenvalues nearer to each other than this share of the largest one stay in one interval.
CUT = 1e-9
RANK = 1e-14


# --- passes over the vectors --------------------------------------------------------


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that hold finite entries only, as doubles; of the most frequent length."""
    v = F.col(vector).cast("array<double>")
    fine = rows.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    size = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size("v") == (size.d if size else 0))


def _matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    """The integer vectors of a batch, one in a row."""
    flat = b.column(b.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat)
    if len(x) and np.abs(x).max() >= 2**53 - SHIFT:
        raise OverflowError("an entry of a vector is too large to be counted in 64ths")
    return x.astype(np.int64).reshape(-1, d) + SHIFT


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b, d)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array([str(t) for t in total])], names=["n", "i", "total"])

    return run


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    parts = vectors.select("v").mapInArrow(_sums(d), "n long, i long, total string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # d rows
    return found[0].n, [int(r.s) for r in found]


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n * x - S``, exactly: 64-bit integers where they fit, else Python's."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
    return n * x - np.array(s, np.int64) if reach < 2**62 else n * x.astype(object) - np.array(s, object)


def _products(d: int, rows):
    """One matrix of summed products per task; ``rows`` turns the integer vectors into what is multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            y = rows(_matrix(b, d))
            total = total + np.hstack([np.ones((len(y), 1)), y]).T @ np.hstack([np.ones((len(y), 1)), y])
        if np.ndim(total):
            k = len(total)
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def covariance(vectors: DataFrame, n: int, d: int, k: int, rows) -> np.ndarray:
    """Covariance (divisor n) of what ``rows`` makes of the vectors: k values, centred by it up to rounding.

    What rounding left of the mean is taken off: E[yy'] - E[y]E[y]'.
    """
    found = vectors.select("v").mapInArrow(_products(d, rows), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    m = np.zeros((k + 1, k + 1))
    for r in found.collect():  # (k + 1) squared values
        m[r.i, r.j] = r.v
    m /= n
    return m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])


# --- spectrum -----------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the inertia of ``v``, shift by shift (Householder)."""
    a = v.astype(float).copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size:
            x /= size
            a[k + 1:, :] -= 2 * np.outer(x, x @ a[k + 1:, :])
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of ``T - shift I``."""
    diag, off = t
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, above = 1.0, 0
    for i in range(len(diag)):
        pivot = diag[i] - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def _kth(t: tuple[np.ndarray, np.ndarray], k: int, low: float, high: float, steps: int = 60) -> float:
    """The k-th largest eigenvalue (from 1), by bisection."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if count_above(t, mid) >= k else (low, mid)
    return (low + high) / 2


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, eigenvalues inside)`` that hold at least the ``wanted`` largest ones above rounding noise."""
    d, t = len(v), tridiagonal(v)
    reach = float(np.abs(v).sum(1).max()) * 1.01  # Gershgorin
    if reach == 0:
        return []
    value = lru_cache(None)(lambda k: _kth(t, k, -reach, reach))
    largest = value(1)
    want = min(wanted, count_above(t, largest * RANK * d))

    def gap(k: int) -> float:
        return value(k) - value(k + 1) if k < d else float("inf")

    cuts, at = [], 0
    while at < want:
        # The widest gap towards the end of the next slice; without one, the slice grows up to the next gap.
        goal = min(at + SLICE, want)
        near = [k for k in (range(max(at + 1, goal - SLICE // 2), goal + 1) if goal < want else [want]) if gap(k) > CUT * largest]
        at = max(near, key=gap) if near else next(k for k in range(goal, d + 1) if gap(k) > CUT * largest)
        cuts.append((value(at) + value(at + 1)) / 2 if at < d else value(d) - max(abs(value(d)) / 2, largest * CUT))
    out, high = [], reach
    for low in cuts:
        out.append((low, high, count_above(t, low) - count_above(t, high)))
        high = low
    # The first interval ends just above the largest eigenvalue: a tight circle converges faster.
    top = largest + max((largest - out[0][0]) / 2, largest * CUT)
    out[0] = (out[0][0], top, count_above(t, out[0][0]))
    return [(float(low), float(high), int(n)) for low, high, n in out]


def feast(v: np.ndarray, low: float, high: float, expected: int, nodes: int = NODES, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``expected`` eigenpairs of ``v`` with eigenvalues in ``(low, high)``."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi / 2 * (1 + points)  # the upper half circle; the lower one is its conjugate
    scale = np.linalg.norm(v, 2)
    size = min(d, expected + max(4, expected // 2))
    for _ in range(4):
        y = np.random.default_rng(expected).standard_normal((d, size))
        for _ in range(rounds):
            q = np.zeros((d, size))
            for a, w in zip(angles, weights):
                step = radius * np.exp(1j * a)
                q += (w / 2) * (step * np.linalg.solve((centre + step) * np.eye(d) - v, y)).real
            q, _ = np.linalg.qr(q)
            values, small = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
            y = q @ small
            inside = (values > low) & (values < high)
            rest = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0)
            if inside.sum() == expected and (rest <= 50 * np.finfo(float).eps * scale).all():
                return values[inside], y[:, inside]
        size, nodes = min(d, 2 * size), nodes + 4
        points, weights = np.polynomial.legendre.leggauss(nodes)
        angles = np.pi / 2 * (1 + points)
    raise ArithmeticError(f"contour integration found {int(inside.sum())} of {expected} eigenvalues in ({low}, {high})")


def components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors in columns; one Spark task per interval."""
    d = len(v)
    cuts = intervals(v, wanted)
    if not cuts:
        return np.empty(0), np.empty((d, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.to_pylist():
                values, vectors = feast(v, c["low"], c["high"], c["expected"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["e", "u"])

    tasks = spark.createDataFrame(cuts, "low double, high double, expected int").repartition(len(cuts), "low")
    found = tasks.mapInArrow(run, "e double, u array<double>").collect()  # at most wanted + SLICE vectors of d entries
    basis, _ = np.linalg.qr(np.array([r.u for r in sorted(found, key=lambda r: -r.e)]).T)
    values, small = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values)[:wanted]
    values, vectors = values[order], (basis @ small)[:, order]
    keep = values > values[0] * RANK * d
    values, vectors = values[keep], vectors[:, keep]
    flip = vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0
    return values, np.where(flip, -vectors, vectors)


# --- the operator -------------------------------------------------------------------

OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double"


def whiten(rows: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component."""
    spark, vectors = rows.sparkSession, usable(rows, vector)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {OUT}"
    head = vectors.select(F.size("v")).first()
    nothing = spark.createDataFrame([], f"{schema}, identity_error double")
    if not head or not head[0]:
        return nothing
    d = head[0]
    n, s = sums(vectors, d)

    def centred(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, s) / n).astype(float)

    v = covariance(vectors, n, d, d, centred)
    e, u = components(spark, (v + v.T) / 2, wanted)
    if not len(e):
        return nothing
    k, scaled, share = len(e), u / np.sqrt(e), e / np.trace(v)
    error = float(np.abs(covariance(vectors, n, d, k, lambda x: centred(x) @ scaled) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):  # k rows out for each row in
                b = whole.slice(at, 2048)
                y = _centred(_matrix(b, d), n, s)
                small = y.dtype != object and int(np.abs(y).max()) ** 2 * d < 2**62
                square = ((y if small else y.astype(object)) ** 2).sum(1)
                far = pa.array([int(q) for q in square]).cast(pa.decimal128(38, 0)) if small else pa.array([_decimal(q) for q in square], pa.decimal128(38, 0))
                row = pa.array(np.repeat(np.arange(b.num_rows), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(row), n)), far.take(row),
                     pa.array(((y / n).astype(float) @ scaled).ravel()), pa.array(np.tile(share, b.num_rows))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(project, schema).withColumn("identity_error", F.lit(error))


def _decimal(q: int):
    from decimal import Decimal

    return Decimal(int(q))
