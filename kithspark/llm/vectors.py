"""Vectors as 64-value float32 blocks between Spark and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

DIMS = 64


def usable(vector: str, dims: int = DIMS) -> Column:
    """Not null, ``dims`` finite values, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """The rows of a list or binary column as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) and not column.null_count and len(column):
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
        return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, dims)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dims)
    flat = column.flatten()
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double and then stored as float32."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)  # keeps the squares of very large and very small values in range
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a float32 matrix as a binary column."""
    n, dims = x.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (4 * dims)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, dtype=np.float32))])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double, rounded to 6 decimals."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.round((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), 6)
