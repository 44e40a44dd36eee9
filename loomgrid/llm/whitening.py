"""Embedding whitening: components of the covariance of rounded vectors, and every vector's place along them.

Each task streams its vectors through Welford's update, which moves a mean and adds one rank-one term of centred differences to a scatter matrix. The tasks' moments are merged by the
parallel form of that update, in a tree of small shuffles, so one row of dims x dims numbers reaches the driver, which solves it by Householder reduction and implicit QR steps.
Sums are integers and exact; nothing is squared before it is centred.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomgrid.llm.common import materialize

#: Steps of rounding in a unit, components returned, and moments that one merge takes.
SCALE, COMPONENTS, FAN = 256, 4, 16
_LONG = 1 << 63
_MOMENTS = "p_part long, p_n long, p_sums array<decimal(38,0)>, p_mean binary, p_scatter binary"


def rounded(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as integers; what lies beyond a long is held at its ends."""
    with np.errstate(over="ignore"):
        steps = np.floor(SCALE * values.astype(np.float64))
    out = np.zeros(steps.shape, np.int64)
    inside = (steps >= -float(_LONG)) & (steps < float(_LONG))
    out[inside] = steps[inside].astype(np.int64)
    out[steps >= float(_LONG)], out[steps < -float(_LONG)] = _LONG - 1, -_LONG
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, each as narrow as it can be, so that equal rows have equal bytes."""
    if not len(x):
        return []
    most = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
    narrow, middle = x.astype("<i2"), x.astype("<i4")
    return [(narrow[i] if m < 1 << 15 else middle[i] if m < 1 << 31 else x[i]).tobytes() for i, m in enumerate(most.tolist())]


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.array([np.frombuffer(b, f"<i{len(b) // dims}") for b in column.to_pylist()], np.int64).reshape(-1, dims)


def rounded_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(w_id, w_dims, w_x) of the vectors that are not null, not empty and hold finite numbers only; w_x packs the rounded components."""
    kind = "array<float>" if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else "array<double>"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["v"]
            flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)  # a null is NaN
            start, stop = np.asarray(column.offsets)[:-1], np.asarray(column.offsets)[1:]
            size = np.where(np.asarray(column.is_valid()), stop - start, 0)
            for dims in np.unique(size[size > 0]).tolist():  # one in an ordinary table
                rows = np.flatnonzero(size == dims)
                given = flat[start[rows][:, None] + np.arange(dims)]
                good = np.isfinite(given).all(axis=1)
                rows = rows[good]
                yield pa.RecordBatch.from_arrays([batch["w_id"].take(pa.array(rows)), pa.array(np.full(len(rows), dims, np.int64)), pa.array(_packed(rounded(given[good])), pa.binary())], names=["w_id", "w_dims", "w_x"])

    narrow = vectors.select(F.col(id_col).alias("w_id"), F.col(vec_col).cast(kind).alias("v"))
    return narrow.mapInArrow(convert, f"w_id {narrow.schema['w_id'].dataType.simpleString()}, w_dims long, w_x binary")


class Moments:
    """Count, exact sums, mean and scatter (the sum of outer products of centred vectors)."""

    def __init__(self, dims: int) -> None:
        self.n, self.sums, self.mean, self.scatter = 0, [0] * dims, np.zeros(dims), np.zeros((dims, dims))
        self._term = np.empty((dims, dims))

    def update(self, rows: np.ndarray) -> None:
        """Welford's rank-one update, row by row."""
        if rows.dtype == np.int64 and len(rows):
            safe = max(int(rows.max()), -int(rows.min())) < (1 << 62) // len(rows)
            added = rows.sum(axis=0).tolist() if safe else [sum(c) for c in rows.T.tolist()]
            self.sums = [a + b for a, b in zip(self.sums, added, strict=True)]
        mean, scatter, term, n = self.mean, self.scatter, self._term, self.n
        for row in rows.astype(np.float64):
            n += 1
            before = row - mean
            mean += before / n
            np.multiply(before[:, None], (row - mean)[None, :], out=term)
            scatter += term
        self.n = n

    def merge(self, n: int, sums: list[int], mean: np.ndarray, scatter: np.ndarray) -> None:
        """The moments of both sets of rows."""
        both = self.n + n
        between = mean - self.mean
        self.scatter += scatter + np.outer(between, between) * (self.n / both * n)
        self.mean += between * (n / both)
        self.n, self.sums = both, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self, part: int) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0))), pa.array([self.mean.tobytes()], pa.binary()), pa.array([self.scatter.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["p_part", "p_n", "p_sums", "p_mean", "p_scatter"])


def moments(rows: DataFrame, dims: int, decode) -> Moments | None:
    """The moments of all `rows`; `decode` makes a matrix of a batch. None for no rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(dims)
        for batch in batches:
            own.update(decode(batch))
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    def merged(table: pa.Table) -> Moments:
        both = Moments(dims)
        for r in table.sort_by("p_part").to_pylist():
            both.merge(r["p_n"], [int(s) for s in r["p_sums"]], np.frombuffer(r["p_mean"]), np.frombuffer(r["p_scatter"]).reshape(dims, dims))
        return both

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([merged(table).row(key[0].as_py())])

    found = materialize(rows.mapInArrow(stream, _MOMENTS))
    parts = (found.agg(F.max("p_part")).first()[0] or 0) + 1
    while parts > FAN:
        parts = -(-parts // FAN)
        found = materialize(found.groupBy(F.expr(f"p_part div {FAN}").alias("p_to")).applyInArrow(merge, _MOMENTS))
    last = found.toArrow()  # at most FAN rows
    return merged(last) if len(last) else None


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows) by Householder reduction to three diagonals and QR steps with implicit shifts.

    An eigenvector's largest component is positive.
    """
    a = np.array(matrix, float)
    n = len(a)
    scale = np.abs(a).max() or 1.0
    a /= scale
    vectors = np.eye(n)  # rows: the transposed product of all rotations
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or np.abs(v[1:]).max() == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    diagonal, beside = np.diag(a).tolist(), np.diag(a, -1).tolist()
    tiny = np.finfo(float).eps
    high, steps = n - 1, 0
    while high > 0:
        for i in range(high):
            if abs(beside[i]) <= tiny * (abs(diagonal[i]) + abs(diagonal[i + 1])) or abs(beside[i]) < 1e-300:
                beside[i] = 0.0
        if beside[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and beside[low - 1] != 0:
            low -= 1
        steps += 1
        if steps > 60 * n:
            raise ArithmeticError("QR steps do not converge")
        # Wilkinson's shift: the eigenvalue of the last two rows that is nearer the last entry.
        half, off = (diagonal[high - 1] - diagonal[high]) / 2, beside[high - 1]
        shift = diagonal[high] - off * off / (half + math.copysign(math.hypot(half, off), half))
        x, z = diagonal[low] - shift, beside[low]
        for i in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if i > low:
                beside[i - 1] = r
            p, q, b = diagonal[i], diagonal[i + 1], beside[i]
            diagonal[i] = c * c * p + 2 * c * s * b + s * s * q
            diagonal[i + 1] = s * s * p - 2 * c * s * b + c * c * q
            beside[i] = c * s * (q - p) + (c * c - s * s) * b
            if i < high - 1:
                x, z = beside[i], s * beside[i + 1]
                beside[i + 1] *= c
            upper = vectors[i].copy()
            vectors[i] = c * upper + s * vectors[i + 1]
            vectors[i + 1] = c * vectors[i + 1] - s * upper
    values = np.array(diagonal) * scale
    order = np.argsort(-values, kind="stable")
    vectors = vectors[order]
    signs = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])
    return values[order], vectors * signs[:, None]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; null beyond a long."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if len(sums) * most * most < _LONG:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < _LONG else None for e in exact]


def _whitened(rows: DataFrame, dims: int, components: int) -> DataFrame:
    """The rows of `whiten` for vectors of one length. `rows` has (w_id, w_dims, w_x)."""
    id_type = rows.schema["w_id"].dataType.simpleString()
    fit = materialize(rows.select("w_x").distinct())
    own = moments(fit, dims, lambda batch: _unpacked(batch["w_x"], dims))
    covariance = (own.scatter + own.scatter.T) / 2 / own.n
    values, vectors = symmetric_eigen(covariance)
    trace, n, sums = float(np.trace(covariance)), own.n, own.sums
    count = min(components, dims)
    real = values[:count] > 16 * dims * np.finfo(float).eps * trace  # without spread along it, a component scales nothing
    turned = vectors[:count].T / np.sqrt(np.where(real, values[:count], 1.0))
    mean = np.array([s / n for s in sums])
    explained = (np.maximum(values[:count], 0) / trace if trace > 0 else np.zeros(count)).tolist()

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = _unpacked(column, dims)
        return x, (x - mean) @ turned

    error = None
    if real.any():
        check = moments(fit, int(real.sum()), lambda batch: project(batch["w_x"])[1][:, real])
        error = float(np.abs(check.scatter / check.n - np.eye(int(real.sum()))).max())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.num_rows
            x, white = project(batch["w_x"])
            ids = batch["w_id"].take(pa.array(np.repeat(np.arange(many), count)))
            repeat = lambda values: pa.array(values * many, pa.float64())
            columns = [ids, pa.array(np.tile(np.arange(1, count + 1), many), pa.int32()), pa.array(np.full(many * count, n), pa.int64()), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(many), count)))]
            columns += [pa.array(white.ravel(), pa.float64(), mask=np.tile(~real, many)), repeat(explained), repeat([error] * count)]
            yield pa.RecordBatch.from_arrays(columns, names=["w_id", "w_component", "w_n", "w_deviation", "w_value", "w_explained", "w_identity_error"])

    return rows.mapInArrow(score, f"w_id {id_type}, {_SHAPE}")


_SHAPE = "w_component int, w_n long, w_deviation long, w_value double, w_explained double, w_identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For every usable vector and component from 1 on: w_id, w_component, w_n (distinct vectors), w_deviation, w_value, w_explained, w_identity_error.

    Vectors that are null, empty, or hold null or non-finite entries are left out; repeated rows get the same values each, a null id is an id like any other, and an empty
    table gives an empty result. Vectors of one length are whitened among themselves; with fewer dimensions than `components` there are as many components. A component along which
    the vectors do not differ (equal vectors, a single one, fewer vectors than components) has a null w_value, and counts neither in w_explained nor in w_identity_error. A deviation
    beyond a long is null. Other columns are not read.
    """
    rows = rounded_vectors(vectors, id_col, vec_col)
    out = None
    for (dims,) in rows.select("w_dims").distinct().collect():  # one in an ordinary table
        part = _whitened(rows.filter(F.col("w_dims") == dims), dims, components)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], f"w_id {rows.schema['w_id'].dataType.simpleString()}, {_SHAPE}")
