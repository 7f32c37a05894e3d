"""Principal components of integer vectors and whitened rows, by a randomised range finder.

The span of the leading components is found from random directions, more of them than components wanted, that are
multiplied by the covariance again and again: each pass is one job over all centred rows, whose tasks send one sum
of a size that the dimensions alone decide. Rayleigh and Ritz give components within that span. If their residuals
don't vanish beside the gaps between eigenvalues, the span is expanded to all dimensions, where they are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_shared, shared_dir

_LOW = 31  # sums are kept of the low bits and of the rest, so that neither overflows
_LONG = (1 << 63) - 1


def in_use(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and holds neither null nor non-finite components; zeros are fine."""
    bad = F.exists(vector.cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * c) of each component c as a long."""
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(F.lit(scale) * v))


def _longs(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of longs with zeros up to `width`."""
    at = vectors.offsets.to_numpy().astype(np.int64)
    n, flat = np.diff(at), vectors.values.to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat[at[0] : at[-1]].reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = flat[at[0] : at[-1]]
    return out


def _over_rows(rows: DataFrame, of: callable, size: int) -> np.ndarray:
    """The sum over all rows of `of`, which gives `size` doubles for a batch of vectors; a task sends that many, and so does the last step."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for b in it:
            if b.num_rows:
                total, seen = total + of(b.column(0)).ravel(), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    total = rows.select("x").mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(total, key=lambda r: r["at"])])


@dataclass
class Whitening:
    """n vectors with sums per dimension; vectors: unit eigenvectors as columns, by falling value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int
    full: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums per dimension) of vectors x."""
    x = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    x = x.agg(F.sum(F.shiftright("v", _LOW)).alias("high"), F.sum(F.col("v").bitwiseAND((1 << _LOW) - 1)).alias("low")).collect()
    out = [0] * (max((r["i"] for r in x), default=-1) + 1)
    for r in x:
        out[r["i"]] = (r["high"] << _LOW) + r["low"]
    return rows.count(), out


def _ritz(basis: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the covariance within an orthonormal basis; times: the covariance times the basis."""
    small = basis.T @ times
    value, u = np.linalg.eigh((small + small.T) / 2)
    value, u = value[::-1], u[:, ::-1]
    vector = basis @ u
    return value, vector, np.linalg.norm(times @ u - vector * value, axis=0)


def fit(rows: DataFrame, components: int = 4, oversample: int = 12, passes: int = 6, tolerance: float = 1e-11, seed: int = 7) -> Whitening | None:
    """Components of the rows' distinct vectors x (array of longs), each once; None if there are no rows.

    A component is accepted from the span of components + oversample directions if its residual is at most `tolerance` of
    the gap between its eigenvalue and the next ones; that bounds the angle to the true component. After `passes` products without
    success the span is all dimensions: one more pass sums the whole covariance, which is dimensions squared doubles a task. Equal
    eigenvalues have no gap and so always take that way. Components without variance (below 1e-12 of the largest) are left out.
    Vectors of different lengths count as filled up with zeros.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(at)
    try:
        x = spark.read.parquet(at)
        n, sums = _sums(x)
        if not n:
            return None
        width = len(sums)
        mean = np.array([s / n for s in sums])
        centred = lambda c: _longs(c, width) - mean
        trace = float(_over_rows(x, lambda c: np.square(centred(c)).sum(), 1)[0]) / n

        def product(basis: np.ndarray) -> np.ndarray:
            return _over_rows(x, lambda c: (m := centred(c)).T @ (m @ basis), width * basis.shape[1]).reshape(width, -1) / n

        span = min(width, components + oversample)
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, span)))[0]
        done, full = 0, span == width
        while True:
            if full:
                basis = np.eye(width)
            times = product(basis)
            done += 1
            value, vector, residual = _ritz(basis, times)
            gap = np.minimum(-np.diff(value, prepend=np.inf), -np.diff(value, append=-np.inf))[:components]
            if full or (residual[:components] <= tolerance * gap).all():
                break
            if done >= passes:
                full = True
            basis = np.linalg.qr(times)[0]
        keep = min(components, int((value > 1e-12 * max(value[0], 0)).sum())) if value[0] > 0 else 0
        value, vector = value[:keep], vector[:, :keep]
        error = 0.0
        if keep:
            seen = _over_rows(x, lambda c: np.vstack([(z := _whitened(centred(c), vector, value)).T @ z, z.sum(0)]), (keep + 1) * keep).reshape(keep + 1, keep) / n
            error = float(np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(keep)).max())
        return Whitening(n, sums, value, vector, trace, error, done, full)
    finally:
        delete_shared(spark, at)


def _whitened(centred: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return centred @ vectors / np.sqrt(values)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S) ** 2 of each row, exact; None beyond longs."""
    most = (float(n) * np.abs(x.astype(np.float64)) + np.abs(np.array(sums, np.float64))).max(1, initial=0)
    small = most < 3e9 / np.sqrt(max(1, x.shape[1]))
    out: list[int | None] = [None] * len(x)
    exact = np.square(n * x[small] - np.array([s if abs(s) <= _LONG else 0 for s in sums])).sum(1).tolist()
    for i, v in zip(np.flatnonzero(small).tolist(), exact, strict=True):
        out[i] = v
    for i in np.flatnonzero(~small).tolist():
        v = sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), sums, strict=True))
        out[i] = v if v <= _LONG else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4, scale: float = 256.0, oversample: int = 12, passes: int = 6) -> DataFrame:
    """A row (id, component, n, deviation, whitened, explained, identity_error) for each vector and each component, numbered from 1.

    Vectors become longs floor(scale * c); components are fitted on the distinct ones. Vectors that are null or empty or hold null or
    non-finite entries give no rows; repeated rows and ids give repeated rows; an empty table gives none. Rows of tables without
    variance have no component. Other columns are not looked at. deviation is null where it is no long.
    What each task gets is the sums and components: dimensions times components.
    """
    rows = vectors.where(in_use(F.col(vector))).select(F.col(id_col).alias("id"), scaled(F.col(vector), scale).alias("x"))
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(rows, components, oversample, passes)
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], schema)
    explained, k, names = w.values / w.trace, len(w.values), [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, m = _longs(b.column(1), len(w.sums)), b.num_rows
            z = _whitened(x - w.mean, w.vectors, w.values)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(_deviation(x, w.n, w.sums), pa.int64()).take(each)]
            columns += [pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(apply, schema)
