"""Batches of vectors as whole-number matrices, and sums of matrices over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are turned into a matrix at once.
ROWS = 4096
#: A component c becomes floor(SCALE * c).
SCALE = 1024


def finite(v: Column) -> Column:
    """Not null, and no entry null or not finite; true for an empty vector."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrices(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) of the vectors with ``dims`` entries, all of them finite."""
    for a in range(0, batch.num_rows, ROWS):
        lists = batch.column(column).slice(a, ROWS)
        sizes = lists.value_lengths()
        at = np.flatnonzero(sizes.fill_null(-1).to_numpy(zero_copy_only=False) == dims)
        flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is NaN
        x = flat.reshape(len(at), dims)
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield a + at[fine], x[fine]


def whole(x: np.ndarray, limit: int) -> np.ndarray:
    """floor(SCALE * x) as int64; an error where it reaches ``limit``, as sums and squares would not be exact."""
    y = np.floor(SCALE * x)
    if len(y) and np.abs(y).max() >= limit:
        raise ValueError(f"a component is too large: {np.abs(y).max() / SCALE} of {limit // SCALE}")
    return y.astype(np.int64)


def totals(rows: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], exact: bool = False) -> list:
    """The sum over all partitions of the array that ``emit`` makes of a partition; empty without rows.

    An array has a fixed number of entries, which bounds what reaches the driver: one row for each.
    """
    kind, spark_type = (pa.int64(), "bigint") if exact else (pa.float64(), "double")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = emit(found)
        if x is not None:
            flat = x.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, kind)], ["at", "x"])

    parts = rows.mapInArrow(run, f"at bigint, x {spark_type}")
    value = F.col("x").cast("decimal(38,0)") if exact else F.col("x")
    got = {r["at"]: r["s"] for r in parts.groupBy("at").agg(F.sum(value).alias("s")).collect()}
    return [int(got[i]) if exact else got[i] for i in range(len(got))]
