"""Whitening of embeddings: moments by pairwise merging, principal components, and a second pass that proves the result.

Each partition folds its vectors into (count, sums, mean, centred scatter); two such states merge by the pairwise update of Chan, Golub and
LeVeque, which never subtracts large squares from each other, and treeReduce merges them level by level, so the driver sees a few states of
d * d numbers, however many rows there are. The eigenvectors come from the driver; a second pass over the fit list takes the covariance of what
was whitened and holds it against the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.session import scratch, ship_package

#: Components that are returned, and what one unit of an entry becomes.
COMPONENTS, SCALE = 4, 256
#: Rows that are turned into numbers at a time.
BLOCK_ROWS = 4096
#: An eigenvalue of this share of the largest, times the dimensions, is zero: nothing varies along its component.
ZERO = 4 * np.finfo(float).eps
_SAFE = float(1 << 62)


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter (sum of outer products about the mean) of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(block: np.ndarray) -> Moments:
        """block: rows by dimensions, of longs or doubles; sums of doubles are not kept."""
        mean = block.mean(axis=0, dtype=float)
        off = block - mean
        return Moments(len(block), exact_sums(block) if block.dtype == np.int64 else [], mean + off.mean(axis=0), _scatter(off))

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, delta = self.n + other.n, other.mean - self.mean
        mean = self.mean + delta * (other.n / n)
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], mean, scatter)

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def _scatter(off: np.ndarray) -> np.ndarray:
    """Scatter of rows about their own mean; off is nearly centred, so the correction is tiny."""
    rest = off.mean(axis=0)
    return off.T @ off - len(off) * np.outer(rest, rest)


def exact_sums(block: np.ndarray) -> list[int]:
    """Sums over rows as Python integers, right whatever the entries."""
    if len(block) * float(np.abs(block.astype(float)).max(initial=0)) < _SAFE:
        return block.sum(axis=0).tolist()
    return [sum(column) for column in block.T.tolist()]


@dataclass
class Whitening:
    """What maps x to its whitened coordinates: n, exact sums, components as columns, their eigenvalues and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def offsets(self, block: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they fit, else as Python integers."""
        most = max(map(abs, self.sums), default=0) + self.n * float(np.abs(block.astype(float)).max(initial=0))
        if most < _SAFE:
            return block * np.int64(self.n) - np.array(self.sums, np.int64)
        return block.astype(object) * self.n - np.array(self.sums, object)

    def project(self, offsets: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN along components without variance."""
        scaled = (offsets / self.n).astype(float) @ self.components
        return scaled / np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)


def deviations(offsets: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where it is no long."""
    if offsets.dtype != object:
        most = float(np.abs(offsets.astype(float)).max(initial=0))
        if most * most * max(1, offsets.shape[1]) < _SAFE:
            return (offsets * offsets).sum(axis=1).tolist()
    sums = (sum(v * v for v in row) for row in offsets.tolist())
    return [s if s < 1 << 63 else None for s in sums]


def components_of(moments: Moments, count: int = COMPONENTS) -> Whitening:
    """The leading eigenvectors of the covariance. Eigenvalues that rounding alone explains count as zero."""
    values, vectors = np.linalg.eigh(moments.covariance())
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    least = ZERO * len(moments.mean) * max(values[0], 0.0)
    values = np.where(values > least, values, 0.0)
    return Whitening(moments.n, moments.sums, vectors, values, float(np.trace(moments.covariance())))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): rows whose vector is there and finite throughout; x is floor(scale * entry) as long, at the ends of the longs beyond them."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(e.isNotNull() & finite).select("vec_id", F.transform(e, lambda c: _floor(c, scale)).alias("x"))


def _floor(entry: Column, scale: int) -> Column:
    # The range check also keeps what overflows to infinity a number.
    scaled = entry.cast("double") * F.lit(float(scale))
    limit = float(1 << 63)
    top = F.lit((1 << 63) - 1).cast("long")
    return F.when(scaled >= limit, top).when(scaled <= -limit, -top).otherwise(F.floor(F.when(F.abs(scaled) < limit, scaled)))


def _padded(rows: DataFrame, width: int) -> DataFrame:
    """Shorter vectors are filled up with zeros."""
    missing = F.lit(width) - F.size("x")
    return rows.withColumn("x", F.when(missing > 0, F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(F.col("x")))


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(at, BLOCK_ROWS)
        flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
        yield part, flat.astype(np.int64, copy=False).reshape(-1, width)


def moments(fit: DataFrame, width: int, seen: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """Moments of column x (of seen(x), if given) over all rows, merged in a tree. fit must have a row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(0, [], np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            for _, block in _blocks(batch, width):
                state = state.merge(Moments.of(block if seen is None else seen(block)))
        columns = [pa.array([state.n]), pa.array([[str(s) for s in state.sums]], pa.list_(pa.string())), pa.array([state.mean.tobytes()]), pa.array([state.scatter.tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, ["n", "sums", "mean", "scatter"])

    def state_of(row) -> Moments:
        mean = np.frombuffer(row.mean)
        return Moments(row.n, [int(s) for s in row.sums], mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)))

    ship_package(fit.sparkSession)
    states = fit.select("x").mapInArrow(fold, "n long, sums array<string>, mean binary, scatter binary")
    return states.rdd.map(state_of).treeReduce(Moments.merge, depth=2)


def fit_list(rows: DataFrame) -> tuple[DataFrame, int | None]:
    """Each distinct x once, as a table, with the width; (table, None) where there are no rows."""
    fit = scratch(rows.select("x").distinct(), "fit")
    least, most = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        fit = scratch(_padded(fit, most).distinct(), "fit")
    return fit, most


def whiten(vectors: DataFrame, count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out. Vectors shorter than the longest are filled up with zeros; without
    a dimension, or without rows, nothing is returned. Repeated rows and rows of equal vec_id are rows of their own in the result, and equal x are
    one vector of the fit list; a null vec_id stays null. Along a component without variance (fewer distinct vectors than components, constant
    dimensions) whitened is null, explained is 0 and identity_error leaves it out (0 if none is left). Entries beyond the longs stop at their
    ends; a deviation that is no long is null. Other columns are ignored, whatever their names.
    """
    rows = quantised(vectors, scale)
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(dict(rows.dtypes)["vec_id"])
    fit, width = fit_list(rows)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    model = components_of(moments(fit, width), count)
    live = np.flatnonzero(model.values > 0)
    error = 0.0
    if len(live):
        seen = moments(fit, width, lambda block: model.project(model.offsets(block))[:, live])
        error = float(np.abs(seen.covariance() - np.eye(len(live))).max())
    explained = model.values / model.trace if model.trace > 0 else np.zeros(len(model.values))
    k = len(model.values)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in _blocks(batch, width):
                offsets = model.offsets(block)
                whitened = model.project(offsets)
                which = np.repeat(np.arange(len(block)), k)
                deviation = pa.array(deviations(offsets), pa.int64()).take(pa.array(which))
                columns = [
                    part.column("vec_id").take(pa.array(which)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                    pa.array(np.full(len(which), model.n)),
                    deviation,
                    pa.array(whitened.reshape(-1), from_pandas=True),
                    pa.array(np.tile(explained, len(block))),
                    pa.array(np.full(len(which), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _padded(rows, width).mapInArrow(place, schema)
