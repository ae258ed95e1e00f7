"""Whitening of embeddings: partial moments merged pairwise, eigenvectors on the driver, and a second pass that verifies them.

Entries are counted in steps of 1/1024 above -100000 / 1024, so sums are exact integers. A partition's state is its count,
its exact sums and its scatter about its own mean; two states merge by Chan's formula, which never takes the difference of
two large sums of squares. A state has the size of one covariance matrix, whatever the table's length, and so has all
that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Components of less than this share of the largest eigenvalue are rounding errors of a vector space of fewer dimensions.
LEAST_SHARE = 1e-12
#: Entries beyond this leave the exact integers of a double.
MOST_ENTRY = 2**52 / STEPS
#: Rows that are turned into integers at a time.
ROWS_AT_ONCE = 2048


@dataclass(frozen=True)
class Moments:
    """n vectors, their exact sums (of integers; of other numbers None) and the scatter about their mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        sums = x.sum(axis=0)
        centred = x - sums / len(x)
        return Moments(len(x), sums, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        if len(self.sums) != len(other.sums):
            raise ValueError(f"DimensionMismatch: vectors of {len(self.sums)} and {len(other.sums)} entries")
        apart = other.mean - self.mean
        n = self.n + other.n
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


NONE = Moments(0, np.empty(0, np.int64), np.empty((0, 0)))


def integers(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows of integers: floor(1024 c) + 100000 of each entry c. All must be of one length."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(c) and np.abs(c).max() > MOST_ENTRY:
        raise ValueError(f"EntryTooLarge: an entry beyond {MOST_ENTRY:g} has no exact integer")
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"DimensionMismatch: vectors of {lengths[0]} and {lengths[-1]} entries")
    return np.floor(STEPS * c).astype(np.int64).reshape(len(column), -1) + OFFSET


def _slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def remaining(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors without the rows whose vector is null or has an entry that is null, NaN or infinite."""
    v = F.col(f"`{vector}`")
    return vectors.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def moments(vectors: DataFrame, vector: str = "embedding", of: Callable[[np.ndarray], np.ndarray] = lambda x: x, dtype: type = np.int64) -> Moments:
    """The moments of of(rows of integers) over remaining vectors: one state a partition, merged pairwise as a tree."""

    def run(batches):
        state = NONE
        for batch in batches:
            for some in _slices(batch):
                state = state.merge(Moments.of(of(integers(some.column(0)))))
        yield pa.RecordBatch.from_arrays([pa.array([state.n]), pa.array([state.sums.tobytes()], pa.binary()), pa.array([state.scatter.tobytes()], pa.binary())], names=["n", "sums", "scatter"])

    def decoded(row) -> Moments:
        sums = np.frombuffer(row["sums"], dtype)
        return Moments(row["n"], sums, np.frombuffer(row["scatter"]).reshape(len(sums), len(sums)))

    schema = "n long, sums binary, scatter binary"
    states = vectors.select(f"`{vector}`").mapInArrow(run, schema)
    none = vectors.sparkSession.createDataFrame([(0, b"", b"")], schema)  # a table without partitions has no state of its own
    return states.unionByName(none).rdd.map(decoded).treeReduce(Moments.merge)


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, the unit eigenvectors (columns) of the covariance by falling eigenvalue, their eigenvalues, the trace, and how far whitened's covariance is from the identity."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        return self.values > LEAST_SHARE * self.values[0] if len(self.values) else np.zeros(0, bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """The live components of rows of integers."""
        return (x - self.sums / self.n) @ self.vectors[:, self.live] / np.sqrt(self.values[self.live])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n x - sums) squared of each row; None where a long can't hold it."""
        far = self.n * x - self.sums
        rough = (far.astype(np.float64) ** 2).sum(axis=1)
        exact = (far**2).sum(axis=1).tolist()
        return [d if r < 2.0**63 - 2.0**14 else None for d, r in zip(exact, rough.tolist(), strict=True)]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's remaining vectors, verified by a second pass over them; None if there are none.

    All must be of one length, or the fit fails with DimensionMismatch; entries beyond 2^52 / 1024 fail with EntryTooLarge.
    Repeated rows count as often as they occur. Of an eigenvector and its opposite the one whose largest entry is positive
    is taken. Components without variance (vectors on a plane, or all alike) are dead: they are not verified, and if all
    are dead the identity_error is None.
    """
    vectors = remaining(vectors, vector)
    m = moments(vectors, vector)
    if not m.n:
        return None
    values, axes = np.linalg.eigh(m.scatter / m.n)
    values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0, keepdims=True), 0) < 0, -1.0, 1.0) if axes.size else axes
    w = Whitening(m.n, m.sums, axes, values, float(np.trace(m.scatter)) / m.n)
    if not w.live.any():
        return w
    check = moments(vectors, vector, w.project, np.float64)
    return Whitening(w.n, w.sums, w.vectors, w.values, w.trace, float(np.abs(check.scatter / check.n - np.eye(len(check.sums))).max()))


def whiten(vectors: DataFrame, w: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of each remaining row and component.

    The key may be of any type, null or repeated: rows are told apart by their places. whitened is null for a dead component,
    explained is null where nothing varies. An empty table, or one without a remaining row, gives an empty result; other
    columns are ignored. The whitening goes to the tasks with the function: it has the size of the vectors, not of the table.
    """
    key_field = vectors.schema[key]
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(key, key_field.dataType), *(T.StructField(*f) for f in fields)])
    rows = remaining(vectors, vector).select(f"`{key}`", f"`{vector}`")
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        k, live = len(w.values), np.flatnonzero(w.live)
        explained = pa.array(w.values / w.trace if w.trace > 0 else [None] * k, pa.float64())
        for batch in batches:
            for some in _slices(batch):
                x = integers(some.column(1))
                made = np.full((len(x), k), np.nan)
                made[:, live] = w.project(x)
                each = np.arange(len(x)).repeat(k)
                columns = [
                    some.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.n)), pa.array(w.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(made.ravel(), mask=np.isnan(made.ravel())), explained.take(pa.array(np.tile(np.arange(k), len(x)))), pa.array([w.identity_error], pa.float64()).take(pa.array(np.zeros(len(each), np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 8 components of all embeddings. Null vectors and odd entries leave, repeats stay, an empty table gives an empty result."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(vectors, fit(vectors))
