"""Whitening of vectors from moments that partitions compute and merge.

Each partition computes the count, the sums, the local mean and the scatter around that
mean; two such moments merge by Chan's formula, and treeReduce merges them in rounds, so
that the driver receives one matrix. It decomposes the covariance there; a second pass
over the same list measures the covariance of the whitened vectors against the identity.

Entries become whole numbers ``floor(64 * c) + 1000000`` first. Each distinct vector of
such numbers is fitted once; equal ones are dropped within the tasks before the shuffle, so
that a hot vector is a row for each task.

Rows are dropped whose vector is null or empty, holds null or non-finite entries or entries
of 2^56 and more, or has another length than most distinct vectors of the table (of equally
frequent lengths the longest). Null ids and repeated rows stay as they are. Components of no variance (no more than
rounding leaves) have whitened values of 0 and are left out of the identity error. Equal
eigenvalues come in the order of the decomposition; the largest entry of a component is
positive. No rows give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, map_batches

SCALE, SHIFT = 64.0, 1_000_000
#: A matrix of this dimension takes 128 MB on the driver.
MOST_DIMENSIONS = 4096
LOW_BITS = 20


@dataclass
class Moments:
    """Count, exact sums (in two parts), mean and centred scatter of vectors."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        mean = values.mean(axis=0)
        centred = values - mean
        whole = values if values.dtype == np.int64 else np.zeros(values.shape, np.int64)
        return cls(len(values), (whole >> LOW_BITS).sum(axis=0), (whole & (1 << LOW_BITS) - 1).sum(axis=0), mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Chan's pairwise formula."""
        n = self.n + other.n
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.high + other.high, self.low + other.low, self.mean + gap * (other.n / n), scatter)

    @property
    def total(self) -> list[int]:
        return [(int(h) << LOW_BITS) + int(w) for h, w in zip(self.high, self.low, strict=True)]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(vectors: DataFrame, column: str, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """Moments of a column of vectors of one length, after ``change``; there must be a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = Moments.of(change(matrix(batch.column(0))))
                total = total.merge(part) if total else part
        if total:
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([total.n], pa.int64()),
                **{c: pa.array([getattr(total, c).tobytes()], pa.binary()) for c in ("high", "low", "mean", "scatter")},
            })

    def read(row) -> Moments:
        mean = np.frombuffer(row.mean, np.float64)
        return Moments(row.n, np.frombuffer(row.high, np.int64), np.frombuffer(row.low, np.int64), mean, np.frombuffer(row.scatter, np.float64).reshape(len(mean), -1))

    parts = vectors.select(column).mapInArrow(run, "n long, high binary, low binary, mean binary, scatter binary").rdd.map(read)
    return parts.treeReduce(Moments.merge, depth=3)


@dataclass
class Whitening:
    """What the fit found: all that tasks need to whiten vectors."""

    n: int
    total: list[int]
    components: np.ndarray
    variance: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def used(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.variance > max(float(self.variance.max(initial=0.0)), 0.0) * len(self.total) * np.finfo(float).eps

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if float(np.abs(x).max(initial=0)) * self.n < 2.0**61 and max(map(abs, self.total)) < 2**61:
            return x * np.int64(self.n) - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of whole vectors."""
        scale = np.where(self.used, 1 / np.sqrt(np.where(self.used, self.variance, 1.0)), 0.0)
        return (self.deviations(x) / self.n).astype(float) @ self.components * scale


def squared(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if d.dtype == np.int64 and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that can be used."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**56)) & (F.size(v) > 0)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(fine).select("id", x.alias("x"))


def fit(rows: DataFrame, most: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors ``x``; None without any."""
    scratch = Scratch(rows.sparkSession)
    distinct = scratch.write(rows.select("x").distinct())
    size = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        scratch.drop()
        return None
    if size.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {size.d} dimensions; at most {MOST_DIMENSIONS} are allowed")
    vectors = distinct.where(F.size("x") == size.d)
    m = moments(vectors, "x")
    values, axes = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:most]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    found = Whitening(m.n, m.total, axes, np.maximum(values[order], 0.0), float(np.trace(m.scatter) / m.n))
    if found.used.any():
        again = moments(vectors, "x", found.project)
        inside = np.ix_(found.used, found.used)
        found.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(order)))[inside].max())
    scratch.drop()
    return found


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component up to ``most``, by falling variance.

    ``deviation`` is an exact decimal: the sum over dimensions of (n * x - S)^2.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = whole_vectors(vectors, id_col, vector_col)
    found = fit(rows, most)
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(found.variance)
    share = found.variance / found.trace if found.trace > 0 else np.zeros(k)

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            x, count = matrix(batch.column(1)), batch.num_rows
            at = np.repeat(np.arange(count), k)
            deviation = pa.array(squared(found.deviations(x)), pa.decimal128(38, 0))
            return {
                id_col: batch.column(0).take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                "n": pa.array(np.full(count * k, found.n)),
                "deviation": deviation.take(pa.array(at)),
                "whitened": pa.array(found.project(x).ravel()),
                "explained": pa.array(np.tile(share, count)),
                "identity_error": pa.array(np.full(count * k, found.identity_error)),
            }

        return work

    return map_batches(rows.where(F.size("x") == len(found.total)), make, schema)
