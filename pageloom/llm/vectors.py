"""Vectors in Arrow batches: which are usable, and as matrices of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null or empty, has neither null nor non-finite components, and isn't all zeros."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of doubles with zeros up to `width`, their own lengths)."""
    at = vectors.offsets.to_numpy().astype(np.int64)
    n = np.diff(at)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(n) and (n == width).all():
        return flat[at[0] : at[-1]].reshape(len(n), width), n
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = flat[at[0] : at[-1]]
    return out, n


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays. Scaled first, so that squares neither overflow nor vanish."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0.0), 5e-324)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 5e-324)
