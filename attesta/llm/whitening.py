"""Embedding whitening: principal components of the distinct vectors, and every vector's coordinates on them.

Entries become integers, so that sums over vectors are exact and do not depend on how rows are dealt. Tasks centre the
distinct vectors on the rounded mean and multiply; the products are whole numbers, added exactly over all tasks. What the
rounding of the mean leaves is taken out on the driver in integers: with y = x - m, T the sum of y and G the sum of
products, V = (n G - T T') / n**2. The driver holds one matrix of dimension by dimension, whatever the number of rows.

V is brought to tridiagonal form by Householder reflections. The leading eigenvalues are bisected by Sturm counts (the
number of negative pivots of T - x is the number of eigenvalues below x), and each vector is found by inverse iteration,
orthogonal to those of its cluster, then carried back through the reflections. The projection is broadcast: dimension
by 16 numbers.

Results: rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are those of another
length than most vectors have (of equally frequent lengths the longest counts). Entries beyond +-2**34 count as that.
Repeated rows give repeated results but enter the fit once, as do different rows with equal integers. A null vec_id is
an id like any other. Components without variance cannot be scaled and are not returned; so one distinct vector, or an
empty table, gives no rows. ``deviation`` is null where it exceeds a 64-bit integer. Only the columns vec_id and
embedding are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

COMPONENTS = 16
#: Fixed values of the integer form.
SCALE, OFFSET = 64, 1_000_000
LARGEST = float(2**34)
#: A block's products are exact in doubles if rows * entry**2 stays below 2**53.
BLOCK_ROWS = 8_192
EXACT = 2**53
CLUSTER = 1e-3
EPS = np.finfo(float).eps


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of every row that counts."""
    whole = F.transform("embedding", lambda e: e.cast("double"))
    rows = embeddings.select("vec_id", whole.alias("v")).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"]

    def integer(e: Column) -> Column:
        bounded = F.greatest(F.least(e, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(SCALE * bounded) + OFFSET

    return rows.where(F.size("v") == F.lit(common)).select("vec_id", F.transform("v", integer).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exact: in doubles where every sum is a whole number below 2**53, else in integers of any size."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + matrix(batch.column("x"), dim).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"k": np.arange(dim + 1), "v": np.append(total, n)})

    rows = fit.mapInArrow(task, "k bigint, v bigint").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r["k"]: int(r["v"]) for r in rows}
    return found.get(dim, 0), [found.get(k, 0) for k in range(dim)]


def covariance(fit: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """The covariance of the fit list, each entry rounded once."""
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    upper = np.triu_indices(dim)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for batch in batches:
            x = matrix(batch.column("x"), dim) - centre
            for k in range(0, len(x), BLOCK_ROWS):
                made = products(x[k : k + BLOCK_ROWS])
                gram = made if gram is None else gram + made
        if gram is not None:
            yield pa.RecordBatch.from_pydict({"k": np.arange(len(upper[0])), "v": pa.array([str(v) for v in gram[upper]])})

    summed = fit.mapInArrow(task, "k bigint, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    left = [s - n * int(m) for s, m in zip(total, centre)]
    v = np.zeros((dim, dim))
    for row in summed.collect():  # dim * (dim + 1) / 2 numbers
        i, j = int(upper[0][row["k"]]), int(upper[1][row["k"]])
        v[i, j] = v[j, i] = float(Fraction(n * int(row["v"]) - left[i] * left[j], n * n))
    return v


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections that bring a symmetric matrix to that form."""
    a, n, reflections = v.copy(), len(v), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        u = x / size if size else x
        reflections.append(u)
        if size:
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ u)
            w = p - (p @ u) * u
            rest -= np.outer(u, w) + np.outer(w, u)
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, squares: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative pivots of T - point."""
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(int)
    for d, s in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - points - s / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, bisected until no double lies between the bounds."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    size = max(abs(low[0]), abs(high[0]))
    low, high = low - 2 * EPS * size, high + 2 * EPS * size
    tiny = max(np.finfo(float).tiny / EPS, EPS * EPS * size)
    wanted = len(diagonal) - np.arange(k)  # the j-th largest has so many eigenvalues not above it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        is_above = below(diagonal, off * off, middle, tiny) < wanted
        low, high = np.where(is_above, middle, low), np.where(is_above, high, middle)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift)^-1 b by elimination with row exchanges; a vanishing pivot becomes ``tiny``."""
    n = len(diagonal)
    d, up, upper2, low, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, off.tolist(), b.tolist()
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            d[k], low[k] = low[k], d[k]
            up[k], d[k + 1] = d[k + 1], up[k]
            upper2[k], up[k + 1] = up[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        elif abs(d[k]) < tiny:
            d[k] = tiny
        m = low[k] / d[k]
        d[k + 1] -= m * up[k]
        up[k + 1] -= m * upper2[k]
        x[k + 1] -= m * x[k]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for k in range(n - 1, -1, -1):
        rest = x[k] - (up[k] * x[k + 1] if k + 1 < n else 0.0) - (upper2[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] = rest / d[k]
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns."""
    n = len(diagonal)
    size = max((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max(), np.finfo(float).tiny)
    found, shift, start = np.zeros((n, len(values))), None, 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            start = k
        # Equal eigenvalues are set apart a little, so that the solutions are not the same vector.
        shift = value if shift is None or k == start else min(value, shift - 10 * EPS * size)
        x = np.random.default_rng(k).standard_normal(n)
        for _ in range(5):
            # Another start would only be scaled: what matters is the direction.
            x = solved(diagonal, off, shift, x / np.abs(x).max(), EPS * size)
            for _ in range(2):
                x = x / np.linalg.norm(x)
                x = x - found[:, start:k] @ (found[:, start:k].T @ x)
        found[:, k] = x / np.linalg.norm(x)
    return found


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    size = np.abs(v).max(initial=0.0)
    if not size:
        return np.zeros(k), np.eye(len(v))[:, :k]
    diagonal, off, reflections = tridiagonal(v / size)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for j, u in reversed(list(enumerate(reflections))):
        vectors[j + 1 :] -= 2 * np.outer(u, u @ vectors[j + 1 :])
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


def _deviations(q: np.ndarray) -> pa.Array:
    """Sums of squares, exact. 64-bit arithmetic wraps round, which leaves sums right that fit."""
    rough = (q.astype(float) ** 2).sum(axis=1)
    if q.dtype != object and (rough < 0.99 * 2.0**63).all():
        return pa.array((q * q).sum(axis=1))
    exact = [sum(int(e) * int(e) for e in row) if about < 1.01 * 2.0**63 else 2**63 for row, about in zip(q, rough)]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    if int(np.abs(x).max(initial=0)) * n < 2**62 and int(np.abs(total).max(initial=0)) < 2**62:
        return x * n - total.astype(np.int64)
    return x.astype(object) * n - total


class Whitening:
    """The fitted projection: ``n`` vectors, their sums, eigenvalues, shares of the trace, scaled components."""

    def __init__(self, fit: DataFrame, dim: int, components: int):
        self.n, total = sums(fit, dim)
        self.dim, self.total = dim, np.array(total, object)
        v = covariance(fit, dim, self.n, total)
        trace = float(np.trace(v))
        values, vectors = principal(v, min(components, dim))
        sound = values > dim * EPS * trace
        self.values, self.vectors = values[sound], vectors[:, sound]
        self.explained = self.values / trace if trace else self.values
        self.scaled = self.vectors / np.sqrt(self.values)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.n, self.total) / self.n).astype(float) @ self.scaled


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The projection learnt from the distinct vectors of ``rows``, and those vectors."""
    fit = stored(rows.select("x").distinct())
    one = fit.select(F.size("x").alias("d")).first()
    return (Whitening(fit, one["d"], components) if one else None), fit


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, measured over all its vectors."""
    k = model.scaled.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(matrix(batch.column("x"), model.dim))
            total, gram = total + w.sum(axis=0), gram + w.T @ w
        yield pa.RecordBatch.from_pydict({"k": np.arange(k + k * k), "v": np.append(total, gram.ravel())})

    rows = fit.mapInArrow(task, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    found = np.zeros(k + k * k)
    for row in rows:
        found[row["k"]] = row["v"] / model.n
    mean, gram = found[:k], found[k:].reshape(k, k)
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row that counts."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation bigint, w array<double>"
    rows = stored(integers(embeddings))
    model, fit = fitted(rows, components)
    if model is None or not len(model.values):
        made = rows.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("w"))
        n, shares, error = 0, [], 0.0
    else:
        n, shares, error = model.n, model.explained.tolist(), identity_error(fit, model)
        held = rows.sparkSession.sparkContext.broadcast(model)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in batches:
                x = matrix(batch.column("x"), model.dim)
                w = pa.FixedSizeListArray.from_arrays(pa.array(model.project(x).ravel()), model.scaled.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _deviations(_centred(x, model.n, model.total)), w], ["vec_id", "deviation", "w"])

        made = rows.mapInArrow(task, schema)
    return made.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
