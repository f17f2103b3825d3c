"""Whitening of embeddings: principal components by MLlib's distributed SVD.

Entries become whole numbers, floor(64 * entry) + 1000000, so counts and sums
are exact.  The rows, centred by their mean, are a distributed matrix whose
singular values s and right vectors come from ``RowMatrix.computeSVD``; the
covariance with divisor n has the eigenvalues s^2 / n.  The total variance is
summed on its own, from exact deviations.  Every component has its largest entry
positive.  The driver sees sums, components and one covariance: tables bounded
by the number of dimensions.

Defined cases: a row whose vector is null, or holds a null or an entry that is
not finite, is left out, and so is a vector of another length than most have (of
lengths as common the smaller) and an entry too large for a whole number of 62
bits; rows that repeat are rows of their own, and a null vec_id stays; components
without variance (below 1e-6 of the largest singular value, where doubles hold noise) have no whitened
values and are not returned, so equal vectors, one row or none give an empty
result; a deviation that no long can hold is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.shipping import ship

SCALE, SHIFT, COMPONENTS, RANK = 64, 1_000_000, 32, 1e-6
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
ROWS = 4096


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of the vectors that count."""
    entries = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float(1 << 62), F.lit(False)))
    return vectors.where(sound).select(F.col("vec_id").cast("long"), F.transform(entries, lambda c: c.cast("long") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, low: int, high: int) -> np.ndarray:
    rows = batch.column("x")[low:high]
    return np.asarray(rows.flatten()).reshape(len(rows), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            yield batch.column("vec_id")[low : low + ROWS], _matrix(batch, low, low + ROWS)


def moments(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, np.int64)
        for _, x in _pieces(batches):
            n, sums = n + len(x), sums + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(dims, dtype=np.int32)), "n": pa.array(np.full(dims, n)), "total": pa.array(sums)})

    found = rows.mapInArrow(run, "dim int, n long, total long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return found[0].n, np.array([r.total for r in found], np.int64)


def components(rows: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, of the covariance with divisor n, and its unit eigenvectors as columns."""
    centred = F.zip_with("x", F.array(*map(F.lit, mean.tolist())), lambda x, m: x.cast("double") - m)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    found = RowMatrix(vectors, n, len(mean)).computeSVD(len(mean), computeU=False, rCond=RANK)
    values, basis = found.s.toArray() ** 2 / n, found.V.toArray()
    some = values > 0
    values, basis = values[some], basis[:, some]
    largest = np.abs(basis).argmax(axis=0)
    return values, basis * np.sign(basis[largest, np.arange(len(values))])


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[list[int | None] | np.ndarray, np.ndarray]:
    """Sum over the dimensions of (n * x - S)^2 of each row, exact, and as doubles."""
    rough = (n * x.astype(np.float64) - sums.astype(np.float64)) ** 2
    if rough.sum(axis=1).max(initial=0) < 2.0**62 and np.abs(x).max(initial=0) < 2**62 // max(n, 1):
        exact = ((n * x - sums) ** 2).sum(axis=1)
        return exact, exact.astype(np.float64)
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in whole], np.array(whole, dtype=np.float64)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    spark = vectors.sparkSession
    ship(spark)
    rows = coded(vectors)
    common = rows.groupBy(F.size("x").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dims = common.dims
    rows = rows.where(F.size("x") == dims)
    n, sums = moments(rows, dims)
    mean = sums / n
    values, basis = components(rows, n, mean)
    values, basis = values[:most], basis[:, :most]
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    weights, k = basis / np.sqrt(values), len(values)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, gram = 0.0, np.zeros((k + 1, k))
        for _, x in _pieces(batches):
            z = (x - mean) @ weights
            gram[:k] += z.T @ z
            gram[k] += z.sum(axis=0)
            spread += float(_deviations(x, n, sums)[1].sum())
        cells = np.append(gram.ravel(), spread)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(cells), dtype=np.int32)), "total": pa.array(cells)})

    cells = np.zeros((k + 1) * k + 1)
    for r in rows.mapInArrow(facts, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        cells[r.cell] = r.total
    gram = cells[:-1].reshape(k + 1, k) / n
    error = float(np.abs(gram[:k] - np.outer(gram[k], gram[k]) - np.eye(k)).max())
    trace = cells[-1] / n / n / n
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _pieces(batches):
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    pa.array(_deviations(x, n, sums)[0], pa.int64()).take(pa.array(each)),
                    pa.array(((x - mean) @ weights).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, SCHEMA)
