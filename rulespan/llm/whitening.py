"""Whitening of embeddings by spectrum slicing.

Vectors become integers floor(scale * c). The covariance is taken over the distinct vectors: their exact sums first, then
second moments of the vectors less a whole-number centre, which tasks multiply block by block (exact in doubles while a
block's sums stay below 2**53) and Spark adds up. Only d * d numbers leave a task, d the dimensions.

The leading eigenvalues come from inertia counts: the signs in an LDLT factorisation of V - s I say how many eigenvalues
lie above s. Halving the range of s isolates an eigenvalue; Rayleigh quotient iteration, started by inverse iteration
inside its slice, converges to it cubically; counts on both sides of the result certify that it is the one of its
number. Eigenvalues closer than the counts can tell apart are one cluster, for which subspace iteration gives
an orthonormal basis.

Defined cases: rows whose vector is null, empty, of another length than the most common one (the longest, if several
are), or holds null, NaN or infinite entries take no part; repeated rows are rows of the result each and one entry of the fit
list; a null id is an id like others; a direction without variance has no component, so equal vectors have
none; products beyond a long become its largest or smallest value; a deviation beyond a long is null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.common import kept_table

#: Rows of a block whose products are added in one matrix product.
BLOCK = 8_192
#: Directions with less than this share of the variance count as having none.
FLAT = 1e-13
_ALPHA = (1 + 17**0.5) / 8


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and x of the rows that take part, whatever their length."""
    v = F.col("v")
    rows = vectors.select(vectors[f"`{id_col}`"].alias("vec_id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("v")).where(
        (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    # floor gives a long, which has no negative zero
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.slice(start, BLOCK), column)


def _added(rows: DataFrame, width: int, each: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """Rows and the sum of ``each(block)``, ``width`` numbers, over all blocks of ``rows`` (x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width)
        for x in _blocks(batches):
            n += len(x)
            total += each(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(total)], names=["at", "n", "part"])

    found = rows.mapInArrow(run, "at int, n long, part double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("part").alias("part")).toArrow()
    out = np.zeros(width)
    if not found.num_rows:
        return 0, out
    out[found.column("at").to_numpy()] = found.column("part").to_numpy()
    return found.column("n")[0].as_py(), out


def sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for x in _blocks(batches):
            n += len(x)
            # the halves of a long add up in longs without overflow
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([t >> 32 for t in total], pa.int64()),
                 pa.array([t & 0xFFFFFFFF for t in total], pa.int64())], names=["at", "n", "high", "low"])

    found = distinct.mapInArrow(run, "at int, n long, high long, low long").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()
    return (found[0]["n"], [(r["high"] << 32) + r["low"] for r in found]) if found else (0, [0] * d)


def covariance(distinct: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance with divisor n. Vectors are centred at whole numbers next to the means, and the rest is taken off the sum."""
    d = len(total)
    centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64) - centre
        return (y.T @ y).ravel()

    _, moments = _added(distinct, d * d, products)
    rest = np.array([(t - n * int(c)) / n for t, c in zip(total, centre)])
    found = moments.reshape(d, d) / n - np.outer(rest, rest)
    return (found + found.T) / 2


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix exceed ``shift``: positive signs in LDLT with complete (1x1 or 2x2) pivots."""
    a = matrix - shift * np.eye(len(matrix))
    n, positive = len(a), 0
    k = 0
    while k < n:
        rest = a[k:, k:]
        size = np.abs(rest)
        diagonal = np.diagonal(size)
        i = int(diagonal.argmax())
        p, q = divmod(int(size.argmax()), n - k)
        if size[p, q] == 0:
            break
        if p == q or diagonal[i] >= _ALPHA * size[p, q]:
            _swap(a, k, k + i)
            positive += a[k, k] > 0
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column, column / a[k, k])
            k += 1
        else:
            low, high = min(p, q), max(p, q)
            _swap(a, k, k + low)
            _swap(a, k + 1, k + high)
            # such a pivot has one eigenvalue of each sign
            positive += 1
            columns = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(a[k : k + 2, k : k + 2], columns.T)
            k += 2
    return int(positive)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    try:
        return np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
    except np.linalg.LinAlgError:
        return np.linalg.solve(matrix - (shift + 1e-15 * scale) * np.eye(len(matrix)), right)


def _basis(matrix: np.ndarray, low: float, high: float, size: int, scale: float, known: list[np.ndarray]) -> np.ndarray:
    """Orthonormal vectors for the ``size`` eigenvalues in (low, high), by inverse iteration from fixed vectors."""
    block = np.random.default_rng(12).standard_normal((len(matrix), size))
    for _ in range(6):
        for u in known:
            block -= np.outer(u, u @ block)
        block = _solve(matrix, (low + high) / 2, block, scale)
        block = np.linalg.qr(block)[0]
    return block


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (fewer, if the rest have no size) and their unit vectors as columns."""
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((len(matrix), 0))
    floor = FLAT * scale
    count = min(count, above(matrix, floor))
    close = 1e-13 * scale
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < count:
        k = len(values)
        # low has more than k eigenvalues above it, high has k
        low, high, more = floor, scale * (1 + 1e-9), above(matrix, floor)
        while more > k + 1 and high - low > close:
            middle = (low + high) / 2
            found = above(matrix, middle)
            if found > k:
                low, more = middle, found
            else:
                high = middle
        # A slice with one eigenvalue may still be wide: halve it until the iteration stays inside.
        while True:
            basis = _basis(matrix, low, high, more - k, scale, vectors)
            if more - k > 1:
                found = np.array([u @ matrix @ u for u in basis.T])
                order = np.argsort(-found)
                values += found[order].tolist()
                vectors += list(basis.T[order])
                break
            u = basis[:, 0]
            value = float(u @ matrix @ u)
            for _ in range(8):
                if np.linalg.norm(matrix @ u - value * u) <= 4e-16 * scale:
                    break
                u = _solve(matrix, value, u, scale)
                u /= np.linalg.norm(u)
                value = float(u @ matrix @ u)
            error = max(float(np.linalg.norm(matrix @ u - value * u)) * 8, close / 8)
            if low - error <= value <= high + error and above(matrix, value - error) == k + 1 and above(matrix, value + error) == k:
                values.append(value)
                vectors.append(u)
                break
            if high - low <= close:
                values.append(value)
                vectors.append(u)
                break
            middle = (low + high) / 2
            if above(matrix, middle) > k:
                low = middle
            else:
                high = middle
    # vectors of close eigenvalues are made exactly orthogonal, in order
    u = np.stack(vectors[:count], axis=1)
    for i in range(count):
        for j in range(i):
            u[:, i] -= (u[:, j] @ u[:, i]) * u[:, j]
        u[:, i] /= np.linalg.norm(u[:, i])
    return np.array([float(u[:, i] @ matrix @ u[:, i]) for i in range(count)]), u


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)**2 of each row, exact; None where it doesn't fit in a long."""
    reach = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, total), default=0)
    if reach < 1 << 62 and reach * reach * len(total) < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row per vector and component."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, scale)
    schema = T.StructType([rows.schema["vec_id"], *[T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    d = size["d"]
    rows = rows.where(F.size("x") == d)
    distinct = kept_table(rows.select("x").distinct())
    n, total = sums(distinct, d)
    matrix = covariance(distinct, n, total)
    values, u = leading(matrix, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    mean = np.array([t / n for t in total])
    explained = (values / np.trace(matrix)).tolist()
    sent = spark.sparkContext.broadcast((mean, u / np.sqrt(values)))
    k = len(values)

    def scores(x: np.ndarray) -> np.ndarray:
        centre, weights = sent.value
        return (x - centre) @ weights

    def second(x: np.ndarray) -> np.ndarray:
        w = scores(x)
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    # Whitened vectors of the fit list have means next to zero, so little is lost in taking these off.
    _, moments = _added(distinct, k + k * k, second)
    middle = moments[:k] / n
    error = float(np.abs(moments[k:].reshape(k, k) / n - np.outer(middle, middle) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x, m = _matrix(part, 1), part.num_rows
                away = deviations(x, n, total)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                     pa.array([v for v in away for _ in range(k)], pa.int64()), pa.array(scores(x).ravel()),
                     pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error))], names=schema.names)

    return rows.mapInArrow(run, schema)
