"""Whitening of embeddings: centred covariance, leading eigenvectors, projection to unit variance.

The rows are read three times, each time in one distributed pass without a shuffle of vectors: their sums, the second moments about
a whole-numbered centre near the mean (what is left of the mean is taken off afterwards, so nothing large cancels), and the projection.
A task sends one matrix of dimension x dimension as rows per band of the matrix; two grouped steps add them, the first over ``SLOTS``
slots, so no task meets more than a fraction of the partial sums.  Sums are kept as a number and its rounding error, and are exact
for whole numbers.  The driver sees the dimension x dimension matrix, whatever the number of rows, and solves it in extended precision:
Householder reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse iteration their vectors,
made orthogonal again within clusters of close eigenvalues.  The projection is broadcast (dimension x components numbers).

Defined cases: rows whose vector is null, empty, or holds a null, a NaN or an infinite entry are left out.  All vectors have the most
frequent length (the longer one of two as frequent); others are left out as well.  Repeated rows count as often as they occur, null keys
stay.  Entries beyond 2**42 count as 2**42, so that every step is exact.  Components without variance (below ``LEAST`` of the largest)
can't be scaled to one and are not returned; a table of equal vectors or an empty one gives no rows.  A deviation beyond a long is null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged, table

# Fixed by the contract.
STEPS_PER_UNIT, OFFSET, COMPONENTS = 1024, 100_000, 8

BOUND = 1 << 52
LEAST = 1e-14
SLOTS = 256
BAND_BYTES = 1 << 16
CLUSTER = 1e-3
ITERATIONS = 4
REAL = np.longdouble
BANDS = "band int, slot int, high binary, low binary"


# ---------------------------------------------------------------- rows


def usable(vector: str) -> Column:
    def sound(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    v = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, sound), F.lit(False))


def whole_numbers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x``, the entries as whole numbers, of all usable rows of the most frequent length."""
    def step(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c * STEPS_PER_UNIT, F.lit(float(-BOUND))), F.lit(float(BOUND)))).cast("long") + OFFSET

    rows = df.where(usable(vector)).select(key, F.transform(F.col(vector).cast("array<double>"), step).alias("x"))
    rows = staged(rows)
    longest = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (longest["size"] if longest else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, 0, 0
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column(0))
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(high), dtype=np.int32)), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])


def sums(rows: DataFrame, column: str = "x") -> tuple[int, list[int]]:
    """Number of rows and exact sum of every entry."""
    found = rows.select(column).mapInArrow(_sums, "dim int, n long, high long, low long").groupBy("dim").agg(
        *[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("dim").collect()  # a row per dimension
    return (found[0]["n"] if found else 0), [(r["high"] << 26) + r["low"] for r in found]


# ---------------------------------------------------------------- second moments


def _added(high: np.ndarray, low: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """high + low + more, with the rounding error of the sum in the second part."""
    total = high + more
    part = total - high
    return total, low + ((high - (total - part)) + (more - part))


def _moments(centre: np.ndarray):
    d = len(centre) + 1
    band = max(1, BAND_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, seen = np.zeros((d, d)), np.zeros((d, d)), False
        for batch in batches:
            if not len(batch):
                continue
            seen = True
            y = (_matrix(batch.column(0)) - centre).astype(np.float64)
            y = np.column_stack([y, np.ones(len(y))])  # the last row of the products holds the sums and the number of rows
            rows = max(1, int(min(len(y), 2.0 ** 53 / max(1.0, float(np.abs(y).max()) ** 2))))  # products of whole numbers stay exact
            for at in range(0, len(y), rows):
                part = y[at:at + rows]
                high, low = _added(high, low, part.T @ part)
        if seen:
            slot, starts = TaskContext.get().partitionId() % SLOTS, range(0, d, band)
            yield pa.RecordBatch.from_arrays([
                pa.array([s // band for s in starts], pa.int32()), pa.array([slot] * len(starts), pa.int32()),
                pa.array([high[s:s + band].tobytes() for s in starts], pa.binary()), pa.array([low[s:s + band].tobytes() for s in starts], pa.binary())],
                names=["band", "slot", "high", "low"])

    return run


def _merged(part: pa.Table) -> pa.Table:
    high = low = np.zeros(len(part.column("high")[0].as_buffer()) // 8)
    for a, b in zip(part.column("high"), part.column("low")):
        high, low = _added(high, low, np.frombuffer(a.as_buffer()))
        low = low + np.frombuffer(b.as_buffer())
    return pa.table({"band": pa.array([part.column("band")[0].as_py()], pa.int32()), "slot": pa.array([part.column("slot")[0].as_py()], pa.int32()),
                     "high": pa.array([high.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary())})


def second_moments(rows: DataFrame, column: str, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of products and sum of the vectors less ``centre``, and their number."""
    parts = rows.select(column).mapInArrow(_moments(centre), BANDS)
    merged = parts.groupBy("band", "slot").applyInArrow(_merged, BANDS).groupBy("band").applyInArrow(_merged, BANDS)
    d = len(centre) + 1
    bands = {r["band"]: np.frombuffer(r["high"]).astype(REAL) + np.frombuffer(r["low"]) for r in merged.toLocalIterator()}
    if not bands:
        return np.zeros((d - 1, d - 1), REAL), np.zeros(d - 1, REAL), 0
    whole = np.concatenate([bands[b] for b in sorted(bands)]).reshape(d, d)
    return whole[:-1, :-1], whole[-1, :-1], int(whole[-1, -1])


def covariance(products: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """Divisor n, about the mean; ``left`` is what the centre of the products left of it."""
    mean = left / REAL(n)
    return products / REAL(n) - np.outer(mean, mean)


# ---------------------------------------------------------------- leading eigenvectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and off-diagonal of a similar matrix, and the reflections that lead there."""
    a, reflections = np.array(matrix, dtype=REAL), []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        if not np.any(x[1:]):
            continue
        size = np.abs(x).max()
        to = -np.copysign(size * np.sqrt(((x / size) ** 2).sum()), x[0])
        x[0] -= to
        x /= np.sqrt((x * x).sum())
        rest = a[k + 1:, k + 1:]
        p = rest @ x
        q = 2 * (p - x * (x @ p))
        rest -= np.outer(x, q) + np.outer(q, x)
        a[k + 1, k] = to
        reflections.append((k + 1, x))
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of ``at``: the negative pivots of a factorisation."""
    tiny = np.finfo(REAL).tiny ** REAL(0.5)
    pivot, count = np.ones(len(at), REAL), np.zeros(len(at), dtype=np.int64)
    for i, here in enumerate(diagonal):
        pivot = here - at - (off[i - 1] * off[i - 1] / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)  # a vanishing pivot counts, and as the number that is carried on
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, each by bisection between counts of what lies below."""
    around = np.zeros(len(diagonal), REAL)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    bottom, top = (diagonal - around).min(), (diagonal + around).max()
    eps = np.finfo(REAL).eps
    slack = eps * max(abs(bottom), abs(top)) + np.finfo(REAL).tiny
    low, high = np.full(k, bottom - slack), np.full(k, top + slack)
    rank = len(diagonal) - 1 - np.arange(k)  # so many lie below the wanted one
    while True:
        middle = (low + high) / 2
        if not np.any((high - low > slack) & (middle > low) & (middle < high)):
            return middle
        more = below(diagonal, off, middle) > rank
        low, high = np.where(more, low, middle), np.where(more, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: REAL, smallest: REAL):
    """Solves (T - value) z = b by elimination with row exchanges, done once."""
    n = len(diagonal)
    main, up, up2 = diagonal - value, np.append(off, 0).astype(REAL), np.zeros(n, REAL)
    factor, swapped = np.zeros(n, REAL), np.zeros(n, bool)
    for i in range(n - 1):
        under = off[i]
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / under
            main[i], up[i], main[i + 1], up2[i], after = under, main[i + 1], up[i] - factor[i] * main[i + 1], up[i + 1], -factor[i] * up[i + 1]
            up[i + 1] = after
        else:
            factor[i] = under / main[i] if main[i] else REAL(0)
            main[i + 1] -= factor[i] * up[i]
    main = np.where(np.abs(main) < smallest, np.copysign(smallest, main), main)

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                z[i], z[i + 1] = z[i + 1], z[i] - factor[i] * z[i + 1]
            else:
                z[i + 1] -= factor[i] * z[i]
        for i in range(n - 1, -1, -1):
            z[i] = (z[i] - (up[i] * z[i + 1] if i + 1 < n else 0) - (up2[i] * z[i + 2] if i + 2 < n else 0)) / main[i]
        return z / np.abs(z).max()

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, reflections: list) -> np.ndarray:
    """Unit eigenvectors of the original matrix as columns; the largest entry of each is positive."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0, np.finfo(REAL).tiny)
    eps = np.finfo(REAL).eps
    rng, found, first, shifted = np.random.default_rng(0), [], 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues are moved apart a little, else every solve would return the same direction
        shifted = value if j == first else min(value, shifted - 10 * eps * norm)
        solve, z = _solver(diagonal, off, shifted, eps * norm), rng.uniform(-1, 1, n).astype(REAL)
        for _ in range(ITERATIONS):
            z = solve(z)
            for other in found[first:] * 2:
                z = z - other * (other @ z)
            z = z / np.sqrt((z * z).sum())
        found.append(z)
    out = np.array(found, dtype=REAL).reshape(len(values), n).T.copy()
    for at, x in reversed(reflections):
        out[at:] -= 2 * np.outer(x, x @ out[at:])
    out /= np.sqrt((out * out).sum(axis=0))
    signs = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return out * signs


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class Whitening:
    """Mean (as count and exact sums), unit eigenvectors as columns, eigenvalues and their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """From all rows of ``whole_numbers``."""
    n, totals = sums(rows)
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], dtype=np.int64)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    products, left, _ = second_moments(rows, "x", centre)
    v = covariance(products, left, n)
    diagonal, off, reflections = tridiagonal(v)
    values = leading_eigenvalues(diagonal, off, min(components, len(v)))
    values = values[(values > LEAST * values[0]) & (np.trace(v) > 0)]
    vectors = leading_vectors(diagonal, off, values, reflections)
    return Whitening(n, totals, vectors.astype(np.float64), values.astype(np.float64), (values / np.trace(v)).astype(np.float64))


def _project(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = shared.value
        n, d = model.n, len(model.sums)
        centre = np.array([(2 * s + n) // (2 * n) for s in model.sums], dtype=np.int64)
        rest = [s - n * int(c) for s, c in zip(model.sums, centre)]
        away = np.array([r / n for r in rest])
        onto = model.vectors / np.sqrt(model.values)
        for batch in batches:
            if not len(batch):
                continue
            y = _matrix(batch.column(1)) - centre
            w = (y - away) @ onto
            if d * float(n) ** 2 * (float(np.abs(y).max()) + 1) ** 2 < 2.0 ** 62:
                deviation = pa.array(((n * y - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1))
            else:
                exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, values], names=["key", "deviation", "whitened"])

    return run


def project(rows: DataFrame, key: str, model: Whitening) -> DataFrame:
    """``key``, ``deviation`` and ``whitened``, an array with an entry per component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), "x").mapInArrow(_project(shared), f"key {kind}, deviation long, whitened array<double>")
    return found.withColumnRenamed("key", key)


def identity_error(projected: DataFrame, k: int) -> float:
    """How far the covariance of ``whitened`` is from the identity, measured on the rows."""
    products, left, n = second_moments(projected, "whitened", np.zeros(k))
    return float(np.abs(covariance(products, left, n) - np.eye(k)).max()) if n and k else 0.0


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """A row per usable row of ``df`` and component."""
    rows = whole_numbers(df, key, vector)
    model = fit(rows, components)
    k = len(model.values)
    projected = staged(project(rows.limit(0) if not k else rows, key, model))
    error = identity_error(projected, k)
    each = projected.select(key, "deviation", F.posexplode("whitened").alias("i", "whitened"))
    share = F.lit([float(x) for x in model.explained] or [0.0])
    return each.select(key, (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
