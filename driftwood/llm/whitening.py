"""Whitening of vectors by their leading principal components.

Method: a randomised range finder.  Random directions, ``k`` and some more (oversampling), are
multiplied by the covariance in passes over all centred rows (power passes), with an orthonormal basis
made after each.  Rayleigh-Ritz on the basis gives eigenvalues and components, and the last pass also
gives their residuals.  Components whose residuals are not at rounding level after ``PASSES`` passes
make the basis grow to the full dimension: the pass over it gives the covariance itself, whose
eigenvectors are components to double precision.

A pass is one job: each partition adds up its product, of ``dims * width`` numbers, and Spark adds the
partitions' together.  Only such matrices reach the driver.  No pass keeps rows; each reads the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table
from ._vectors import finite, matrices, totals, whole

COMPONENTS, OVERSAMPLING, PASSES, SEED = 8, 8, 4, 20240229
#: A residual at most this, relative to the largest eigenvalue, is rounding.
TOLERANCE = 1e-13
#: An eigenvalue below this, relative to the largest, is zero.
ZERO = 1e-12
SHIFT = 100_000
#: |floor(1024 * c)| is below this.
LIMIT = 1 << 40

OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _rows(found: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of the batches' vectors, x in whole numbers."""
    for batch in found:
        for at, v in matrices(batch, 1, dims):
            yield batch.column(0).take(pa.array(at)), whole(v, LIMIT) + SHIFT


def _sums(dims: int) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    """Number of rows and the sum of each dimension."""

    def emit(found: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _rows(found, dims):
            total = np.zeros(dims + 1, np.int64) if total is None else total
            total[0] += len(x)
            total[1:] += x.sum(axis=0)
        return total

    return emit


def _product(dims: int, mean: np.ndarray, basis: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    """Sum over rows of the centred row times its projection on the basis, and of its square."""

    def emit(found: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _rows(found, dims):
            y = x - mean
            total = np.zeros(dims * basis.shape[1] + 1) if total is None else total
            total[:-1] += (y.T @ (y @ basis)).reshape(-1)
            total[-1] += (y * y).sum()
        return total

    return emit


def _moments(dims: int, mean: np.ndarray, maps: np.ndarray, centre: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    """Sums of the whitened rows, or of the products of their components less ``centre``."""

    def emit(found: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in _rows(found, dims):
            w = (x - mean) @ maps
            part = w.sum(axis=0) if centre is None else (w - centre).T @ (w - centre)
            total = part if total is None else total + part
        return total

    return emit


def leading(multiply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, *, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, bool]:
    """(eigenvalues, unit eigenvectors as columns, whether the basis grew to the full dimension) of the
    ``k`` largest eigenvalues of a symmetric matrix that is known by its products alone."""
    width = min(dims, k + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    for _ in range(passes if width < dims else 0):
        image = multiply(basis)
        small = basis.T @ image
        e, z = np.linalg.eigh((small + small.T) / 2)
        e, z = e[::-1][:k], z[:, ::-1][:, :k]
        residual = np.sqrt(((image @ z - (basis @ z) * e) ** 2).sum(axis=0))
        if (residual <= tolerance * max(e[0], 0)).all():
            return e, basis @ z, False
        basis = np.linalg.qr(image)[0]
    full = multiply(np.eye(dims))
    e, z = np.linalg.eigh((full + full.T) / 2)
    return e[::-1][:k], z[:, ::-1][:, :k], True


def _dims(rows: DataFrame, embedding: str) -> int | None:
    """The commonest length of the finite vectors with entries, the longest of several; one row at most is read."""
    sizes = rows.where(finite(F.col(embedding))).groupBy(F.size(embedding).alias("d")).count().where("d > 0")
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return None if first is None else first["d"]


def _whiten_batches(dims: int, n: int, sums: list[int], mean: np.ndarray, maps: np.ndarray, explained: np.ndarray, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = maps.shape[1]
    s = np.array(sums, dtype=object) if max(map(abs, sums), default=0) >= 1 << 62 else np.array(sums, np.int64)

    def deviation(x: np.ndarray) -> pa.Array:
        near = ((n * (x - mean)) ** 2).sum(axis=1)
        if n * (np.abs(x).max(initial=0)) < 1 << 62 and near.max(initial=0) < 9e18:
            d = n * x - s
            return pa.array((d * d).sum(axis=1), pa.int64())
        # Beyond 63 bits there is no long that says it.
        d = n * x.astype(object) - s
        return pa.array([v if v < 1 << 63 else None for v in (d * d).sum(axis=1)], pa.int64())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _rows(found, dims):
            w = (x - mean) @ maps
            w = np.where(np.isnan(explained), np.nan, w)
            each = np.repeat(np.arange(len(x)), k)
            tile = lambda a: np.tile(a, len(x))
            at = pa.array(each)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), pa.array(tile(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(each), n)), deviation(x).take(at), pa.array(w.reshape(-1), from_pandas=True), pa.array(tile(np.nan_to_num(explained))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = SEED) -> DataFrame:
    """A row of OUT for each vector and each of the first ``k`` components.

    Vectors that are null, empty or hold null or non-finite entries have no rows, nor have vectors of
    another length than the commonest (of several, the longest).  Repeated and missing ids stay.  A
    component without variance has ``whitened`` null and ``explained`` 0 and doesn't count in
    ``identity_error``.  ``deviation`` is null where it doesn't fit in a long.  No vectors, no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"))
    dims = _dims(rows, "v")
    if dims is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    n, *sums = totals(rows, _sums(dims), exact=True)
    mean = np.array([s / n for s in sums])
    trace = 0.0

    def multiply(basis: np.ndarray) -> np.ndarray:
        nonlocal trace
        got = np.array(totals(rows, _product(dims, mean, basis))) / n
        trace = got[-1]
        return got[:-1].reshape(dims, basis.shape[1])

    e, components, _ = leading(multiply, dims, min(k, dims), oversampling=oversampling, passes=passes, tolerance=tolerance, seed=seed)
    live = e > ZERO * max(e[0], 0)
    maps = np.where(live, components / np.sqrt(np.where(live, e, 1.0)), 0.0)
    centre = np.array(totals(rows, _moments(dims, mean, maps, None))) / n
    spread = np.array(totals(rows, _moments(dims, mean, maps, centre))).reshape(len(e), len(e)) / n
    error = float(np.abs((spread - np.eye(len(e)))[np.ix_(live, live)]).max(initial=0.0))
    explained = np.where(live, e / trace if trace else 0.0, np.nan)
    return rows.mapInArrow(_whiten_batches(dims, n, sums, mean, maps, explained, error), OUT)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
