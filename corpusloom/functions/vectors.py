"""Vector columns held as arrays of floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either side has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    sizes = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, sizes, lambda x, n: F.when(n == 0.0, F.lit(0.0))
                      .otherwise(x.cast("double") / n))


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width as one double matrix, for use inside tasks."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors must all be {width} wide; see width_report()")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
