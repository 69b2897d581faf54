"""Vectors as whole numbers: what the operators over embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components beyond this count as it, so that squared distances and products of 64 of them fit 64 bits.
MOST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double."""
    part = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * F.lit(float(scale))))).cast("int")
    return F.transform(vector, part)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, shorter ones filled with 0; whole numbers stay exact."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width).astype(np.float64)
    out = np.zeros((len(column), width))
    for row, values in enumerate(column):
        own = values.values.to_numpy(zero_copy_only=False)
        out[row, : len(own)] = own
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if top * top * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
