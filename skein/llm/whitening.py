"""Whitening of embeddings by a compensated covariance.

Means and covariances are sums in double-double arithmetic: a value is an unevaluated sum of a high and a low double,
every product and sum keeps its rounding error by an error-free transformation, and outer products are taken of vectors that
were centred before. Each task sums its rows by halves and emits its matrix row by row, high and low parts; these
are merged for each matrix row, first by runs of tasks and then over all, in the order of the tasks, so reruns agree.
What reaches the driver is one matrix of dimension x dimension. It is solved by LAPACK's tridiagonal divide and conquer
(numpy's ``eigh``), and eigenvalues and vectors are refined against the matrix's full precision.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the integer vectors.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
# An entry above 2^42 has no exact integer form as a double; its row counts as not finite.
LARGEST = float(1 << 42)
BLOCK_CELLS, RUN_TASKS = 1 << 16, 64
SUMS = T.StructType([T.StructField("task", T.LongType()), T.StructField("i", T.LongType()), T.StructField("n", T.LongType())] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("high", "low")])
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: Pair, b: Pair) -> Pair:
    """The sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    h = s + e
    e = (e - (h - s)) + f
    high = h + e
    return high, e - (high - h)


def halves(a: np.ndarray) -> Pair:
    """``a`` as a sum of two doubles of 26 bits."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x - mean in double-double, ``mean`` being one."""
    s, e = two_sum(x, -mean[0])
    e = e - mean[1]
    high = s + e
    return high, e - (high - s)


def outer(y: Pair) -> Pair:
    """Products of all entries of each row (rows x d) with each other, in double-double (rows x d x d)."""
    high, low = y
    top, rest = halves(high)
    a, b = high[:, :, None], high[:, None, :]
    p = a * b
    e = top[:, :, None] * top[:, None, :] - p
    e += top[:, :, None] * rest[:, None, :]
    e += rest[:, :, None] * top[:, None, :]
    e += rest[:, :, None] * rest[:, None, :]
    e += a * low[:, None, :]
    e += low[:, :, None] * b
    return p, e


def by_halves(values: Pair) -> Pair:
    """The sum over the first axis."""
    high, low = values
    while len(high) > 1:
        even = len(high) // 2 * 2
        h, low_ = added((high[0:even:2], low[0:even:2]), (high[1:even:2], low[1:even:2]))
        high, low = np.concatenate([h, high[even:]]), np.concatenate([low_, low[even:]])
    return high[0], low[0]


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` entries, as an array of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def summed(vectors: DataFrame, dim: int, height: int, width: int, terms: Callable[[np.ndarray], Pair]) -> tuple[int, Pair]:
    """(n, sum over all rows of ``terms``) for ``vectors`` (one column: arrays of ``dim`` doubles).

    ``terms`` maps rows (r x dim) to double-double matrices (r x height x width); they are summed by blocks of ``BLOCK_CELLS`` cells.
    """
    step = max(1, BLOCK_CELLS // (height * width))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, (np.zeros((height, width)), np.zeros((height, width)))
        for batch in batches:
            x = rows_of(batch.column(0), dim)
            n += len(x)
            for k in range(0, len(x), step):
                total = added(total, by_halves(terms(x[k : k + step])))
        if n:
            number = TaskContext.get().partitionId()
            for i in range(height):
                yield pa.RecordBatch.from_pylist([{"task": number, "i": i, "n": n, "high": total[0][i].tolist(), "low": total[1][i].tolist()}], schema=ARROW)

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        high, low = (rows_of(t[c].combine_chunks(), width) for c in ("high", "low"))
        total = high[0], low[0]
        for k in range(1, len(high)):
            total = added(total, (high[k], low[k]))
        n = sum(t["n"].to_pylist())
        return pa.Table.from_pylist([{"task": t["task"][0].as_py(), "i": t["i"][0].as_py(), "n": n, "high": total[0].tolist(), "low": total[1].tolist()}], schema=ARROW)

    runs = vectors.mapInArrow(task, SUMS).groupBy("i", F.expr(f"task div {RUN_TASKS}")).applyInArrow(merge, SUMS)
    rows = sorted(runs.groupBy("i").applyInArrow(merge, SUMS).collect(), key=lambda r: r.i)
    if not rows:
        return 0, (np.zeros((height, width)), np.zeros((height, width)))
    return rows[0].n, (np.array([r.high for r in rows]), np.array([r.low for r in rows]))


ARROW = pa.schema([("task", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])


def mean_of(n: int, sums: Pair) -> Pair:
    """sums / n as double-double vectors."""
    exact = [(Fraction(h) + Fraction(e)) / n for h, e in zip(*(s.ravel().tolist() for s in sums))]
    high = [float(f) for f in exact]
    return np.array(high), np.array([float(f - Fraction(h)) for f, h in zip(exact, high)])


def covariance(vectors: DataFrame, dim: int, width: int, seen: Callable[[np.ndarray], np.ndarray]) -> tuple[int, Pair, np.ndarray]:
    """(n, sums, covariance) of ``seen`` (rows x dim to rows x width) over all rows: one pass for the sums, one for the centred products."""
    n, sums = summed(vectors, dim, 1, width, lambda x: (seen(x)[:, None, :], np.zeros((len(x), 1, width))))
    if not n:
        return 0, sums, np.zeros((width, width), np.longdouble)
    mean = mean_of(n, sums)
    _, (high, low) = summed(vectors, dim, width, width, lambda x: outer(centred(seen(x), mean)))
    return n, sums, (high.astype(np.longdouble) + low) / n


def eigen(matrix: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the entry largest in size positive) of a symmetric matrix in long doubles.

    Divide and conquer in doubles, then ``rounds`` corrections from the residuals X'AX and I - X'X; directions whose eigenvalues
    can't be told apart are only made orthogonal.
    """
    x = np.linalg.eigh(matrix.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(rounds):
        off = np.eye(len(matrix)) - x.T @ x
        s = x.T @ matrix @ x
        values = np.diag(s) / (1 - np.diag(off))
        close = 2 * (np.abs(s - np.diag(values)).sum(axis=0).max() + np.abs(values).max() * np.abs(off).sum(axis=0).max())
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        x = x + x @ np.where(apart, (s + values[None, :] * off) / np.where(apart, gap, 1), off / 2)
    values = np.diag(x.T @ matrix @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return values[order], x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])


@dataclass
class Whitening:
    """A fit: vectors of the list, their dimension, exact sums, mean, projection (dim x components), eigenvalues, trace."""

    n: int
    dim: int
    sums: list[int]
    mean: Pair
    projection: np.ndarray
    values: np.ndarray
    trace: float

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows (rows x components); a row's values don't depend on the others."""
        y = (x - self.mean[0]) - self.mean[1]
        return np.stack([(y * w).sum(axis=1) for w in self.projection.T], axis=1)


def integers(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c) + OFFSET


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(rows whose vector can be fitted, their dimension).

    Vectors that are null or empty, or hold a null, an entry that isn't finite or one above 2^42 in size, are dropped. If dimensions differ,
    the most frequent counts (of equally frequent ones the larger), and vectors of others are dropped too. No rows: dimension 0.
    """
    v = F.col(column)
    good = vectors.where((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST)))
    most = good.groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return (good.where(F.size(v) == most.dim), most.dim) if most else (good, 0)


def fitted(vectors: DataFrame, column: str, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of usable rows. Components without variance (under dim * 2^-50 of the trace) are left out."""
    n, sums, v = covariance(vectors.select(column), dim, dim, integers)
    values, q = eigen(v)
    trace = float(np.trace(v))
    many = int((values[:components] > trace * dim * 2.0**-50).sum())
    projection = (q[:, :many] / np.sqrt(values[:many])).astype(np.float64)
    exact = [int(h) + int(e) for h, e in zip(sums[0][0].tolist(), sums[1][0].tolist())]
    return Whitening(n, dim, exact, mean_of(n, sums), projection, values[:many].astype(np.float64), trace)


def identity_error(vectors: DataFrame, column: str, fit: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    many = len(fit.values)
    if not many:
        return 0.0
    _, _, v = covariance(vectors.select(column), fit.dim, many, lambda x: fit.of(integers(x)))
    return float(np.abs(v - np.eye(many)).max())


def deviations(x: np.ndarray, fit: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exactly; null beyond the range of a long."""
    far = fit.n * np.abs(x - fit.mean[0])
    if fit.n * (np.abs(x).max(initial=0) + 1) < 2**62 and (far**2).sum(axis=1).max(initial=0) < 2**62:
        return ((fit.n * x.astype(np.int64) - np.array(fit.sums, np.int64)) ** 2).sum(axis=1).tolist()
    sums = [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, fit.sums)) for row in x.tolist()]
    return [s if s < 2**63 else None for s in sums]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of ``vectors`` (vec_id, embedding) and component; see ``usable``, ``fitted``, ``deviations``.

    vec_id may be null or repeat; repeated rows count as often as they occur, in the fit too. Tables without usable rows, and those
    whose vectors are all equal, have no component: no rows.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding")
    if not dim:
        return spark.createDataFrame([], RESULT)
    fit = fitted(rows, "embedding", dim, components)
    error, many = identity_error(rows, "embedding", fit), len(fit.values)
    if not many:
        return spark.createDataFrame([], RESULT)
    explained = fit.values / fit.trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(rows_of(batch.column(1), dim))
            each = pa.array(np.repeat(np.arange(len(x)), many))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), fit.n, np.int64)),
                pa.array(deviations(x, fit), pa.int64()).take(each),
                pa.array(fit.of(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, RESULT)
