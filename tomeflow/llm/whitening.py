"""Whitening of embeddings by LOBPCG on distributed covariance-block products.

Entries become whole numbers x = floor(64 c) + 1000000; the covariance V is that of the distinct x-vectors. Nothing of
the size of V is made: each iteration hands the orthonormal basis Q of the last block of iterates, their residuals and
the direction before to the executors, which sum X'(XQ) over their centred rows; partial sums are added up in Spark,
and the driver holds matrices of dimension x 3 blocks. Rayleigh-Ritz on Q gives the next iterates. The block
has `GUARD` vectors more than are asked for, so that the last component isn't slowed down by its neighbour. It ends when
the residuals |Vu - eu| of all components, from a product over all rows, are below `CERTIFIED` of the largest
eigenvalue and fall no more; otherwise it raises.

Sums are exact: rows are centred by whole numbers, S = n * base + rest, so n * x - S = n * (x - base) - rest.

Defined results: rows are dropped whose vector is null, empty, or holds nulls, NaN, infinities or entries of 2^40 or
more, for which x and its deviation are no longs; and rows of another length than the most frequent one (of those that
tie, the greater). Null ids stay; repeated rows are rows of the result and one row of the fit list. There are as many components as
dimensions, 16 at most, and only those whose eigenvalue is above rounding (RANK of the largest), so that a single
distinct vector, or an empty table, gives an empty result. A deviation beyond a long stops the query. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, only, written

COMPONENTS = 16
GUARD = 8
#: Residuals, and eigenvalues that count as none, as shares of the largest eigenvalue.
CERTIFIED = 1e-12
RANK = 1e-11
MOST_ITERATIONS = 1000
#: The driver holds ADDERS matrices, and a few more, of so many rows at most and 3 * (COMPONENTS + GUARD) columns: 9 MB each.
MOST_DIMENSIONS = 1 << 14
ADDERS = 8
_ROWS = 4096


class Centre(NamedTuple):
    """n rows with the sums n * base + rest."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n * x - S)^2 of each row. Longs wrap around, so a sum that is a long is exact whatever its parts."""
        y = x - self.base
        about = (self.centred(x) ** 2).sum(axis=1) * float(self.n) ** 2
        if (about > 9.2e18).any():
            raise OverflowError("the deviation of a vector is beyond a long")
        return ((y * np.int64(self.n) - self.rest) ** 2).sum(axis=1)


class Whitening(NamedTuple):
    """What whitens: components are the columns of `vectors`, by falling eigenvalue."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that aren't dropped."""
    c = F.col("embedding")
    sound = rows.where(c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float(1 << 40))) & (F.size(c) > 0))
    length = sound.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform(c, lambda e: F.floor(e.cast("double") * 64).cast("long") + F.lit(1000000).cast("long"))
    return sound.where(F.size(c) == (length.d if length else 0)).select("vec_id", x.alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def centre_of(fit: DataFrame) -> Centre | None:
    """The number of rows and their exact sums; None without rows."""

    def add(batches):
        import pyarrow as pa

        n, high, low = 0, 0, 0  # halves of the numbers are summed apart, so that no sum overflows
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, high, low = n + len(x), high + (x >> 24).sum(axis=0), low + (x & 0xFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(high), pa.array(low), pa.array(np.full(len(high), n))], names=["dim", "high", "low", "n"])

    whole = "decimal(38,0)"
    sums = fit.mapInArrow(add, "dim int, high long, low long, n long").groupBy("dim").agg(F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"), F.sum("n").alias("n"))
    found = sorted((r.dim, (int(r.high) << 24) + int(r.low), r.n) for r in sums.collect())  # a row for each dimension
    if not found:
        return None
    if len(found) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {len(found)} dimensions; {MOST_DIMENSIONS} is the limit")
    n = found[0][2]
    return Centre(n, np.array([s // n for _, s, _ in found], np.int64), np.array([s % n for _, s, _ in found], np.int64))


def summed(fit: DataFrame, centre: Centre, of: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of of(rows), a matrix of height x width, over all blocks of centred rows. Tasks' sums are added up by ADDERS tasks, and those by the driver."""

    def part(batches):
        import pyarrow as pa

        total = np.zeros((height, width))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                total += of(centre.centred(_matrix(batch.column(0).slice(at, _ROWS))))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    def add(batches):
        import pyarrow as pa

        total = np.zeros(height * width)
        for batch in batches:
            for own in batch.column(0):
                total += np.frombuffer(own.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    sums = fit.mapInArrow(part, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary")
    return sum(np.frombuffer(r.sums) for r in sums.collect()).reshape(height, width)  # ADDERS rows


def _independent(columns: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to the orthonormal ones `beside`."""
    norms = np.linalg.norm(columns, axis=0)
    columns = columns[:, norms > 0] / norms[norms > 0]
    if not columns.size or beside.shape[1] == beside.shape[0]:
        return beside[:, :0]
    for _ in range(2):
        columns = columns - beside @ (beside.T @ columns)
    u, s, _ = np.linalg.svd(columns, full_matrices=False)
    u = u[:, s > 1e-9][:, : beside.shape[0] - beside.shape[1]]
    u = u - beside @ (beside.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of the symmetric matrix that product() multiplies by."""
    block = min(d, k + GUARD)
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(d, block)))[0]
    had, best = 0, np.inf
    for _ in range(MOST_ITERATIONS):
        times = product(q)
        ritz = q.T @ times
        values, c = np.linalg.eigh((ritz + ritz.T) / 2)
        values, c = values[::-1][:block], c[:, ::-1][:, :block]
        x = q @ c
        residual = times @ c - x * values
        worst = np.linalg.norm(residual[:, :k], axis=0).max()
        if worst <= CERTIFIED * max(values[0], 0) and not worst < best / 2 or values[0] <= 0:
            return values[:k], x[:, :k]
        best = min(best, worst)
        direction = q[:, had:] @ c[had:]  # what this step added to the iterates before
        x = np.linalg.qr(x)[0] if had else x
        more = _independent(np.hstack([residual, direction] if had else [residual]), x)
        q, had = np.hstack([x, more]), x.shape[1]
    raise ArithmeticError(f"residuals stay at {worst / values[0]:.1e} of the largest eigenvalue")


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors `fit` (x); None if there is none."""
    centre = centre_of(fit)
    if centre is None:
        return None
    d = len(centre.base)
    shared = fit.sparkSession.sparkContext.broadcast

    def product(q: np.ndarray) -> np.ndarray:
        basis = shared(q)
        times = summed(fit, centre, lambda x: x.T @ (x @ basis.value), d, q.shape[1]) / centre.n
        basis.unpersist()
        return times

    trace = float(summed(fit, centre, lambda x: (x * x).sum(axis=0)[:, None], d, 1).sum() / centre.n)
    if trace <= 0:
        return None
    values, vectors = lobpcg(product, d, min(d, components))
    k = int((values > RANK * values[0]).sum())
    values, vectors = values[:k], vectors[:, :k]
    own = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ own
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = summed(fit, centre, moments, k + 1, k) / centre.n
    error = np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max()
    return Whitening(centre, values, vectors, trace, float(error))


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    rows = only(rows, "vec_id", "embedding")
    vectors = whole_vectors(rows)
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components)
    dropped(fit)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], fields)
    k = len(model.values)
    own, explained = model.vectors / np.sqrt(model.values), model.values / model.trace

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part.column(1))
                m, each = len(x), np.repeat(np.arange(len(x)), k)
                columns = [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.centre.n)),
                    pa.array(np.repeat(model.centre.deviations(x), k)),
                    pa.array((model.centre.centred(x) @ own).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, fields)
