"""Helpers shared by the training-data operators: lineage cuts, connected components, prefix sums and fixed-size bitmaps."""

from __future__ import annotations

import math
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="pageloom-")
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Plans made and run within the block leave no shuffle files."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation upstream. The shuffle files that led to it go at once."""
    spark = df.sparkSession
    shared_dir(spark)
    with _without_shuffle_files(spark):
        return df.select("*").checkpoint(eager=True)  # select: a plan made under that setting


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df computed once and kept as Parquet in the shared folder for the block alone: for large steps, as checkpoints stay until the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    try:
        with _without_shuffle_files(spark):
            df.select("*").write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_shared(spark, path)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the session's limit of rows in an Arrow batch: whole texts are long rows, and a batch is held by the JVM and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores behind it as it takes to be none of the columns'."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def in_text_batches(spark: SparkSession) -> Iterator[None]:
    """text_batches() for what is computed within the block; the session's limit comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    text_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete_shared(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, in whatever store it is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of all nodes of the edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return nodes, nodes[label]
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def connected_components(edges: DataFrame, a: str, b: str, at_once: int = 1 << 20) -> DataFrame:
    """(node, component) of every node that an edge between different nodes touches; component is the smallest node reachable.

    Alternates large-star and small-star steps until the forest of stars stops changing: a number of
    rounds logarithmic in the longest path, each round a few equi-joins whose rows never exceed the edges. Once no more
    than `at_once` edges are left, one task finishes them, which holds that many at most.
    Edges with a null end and loops are ignored.
    """

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in it if x.num_rows]
        if ends:
            node, component = _spanning_stars(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    e, before = checkpointed(e), None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] <= at_once:
            return e.coalesce(1).mapInArrow(finish, "node long, component long")
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        e = checkpointed(small.where("u > v").distinct())


def running_offsets(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, size: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows before, within `keys`, in the order of (chunk, *order).

    Two levels, so that one key with most of the rows isn't one task: rows are summed within (keys, chunk),
    and the chunks' totals, a few per key, are summed over the chunks. chunk must not decrease along the order.
    """
    df = df.withColumn("_chunk", chunk).withColumn("_size", size)
    totals = df.groupBy(*keys, "_chunk").agg(F.sum("_size").alias("_total"))
    w = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_base"))
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(totals, same).withColumn(out, F.col("_base") + F.col("_in")).drop("_chunk", "_size", "_c", "_base", "_in", *[f"_k{i}" for i in range(len(keys))])


def zipped(x: np.ndarray) -> bytes:
    """Partial arrays are sparse when there are many of them."""
    return zlib.compress(x.tobytes(), 1)


def merged_slices(parts: DataFrame, how: str, dtype: str) -> dict[int, np.ndarray]:
    """Rows (part long, slice int, data binary: zipped) added or or-ed by slice: the slices of one array of fixed length.

    part is the task that made a row, of a checkpointed table. Partial arrays meet in groups of at most 32, level by level;
    the driver gets the final slices alone, whose total length the caller fixes.
    """

    def merge(key, pdf):
        import pandas as pd

        total = None
        for x in pdf["data"]:
            v = np.frombuffer(zlib.decompress(x), dtype)
            total = v.copy() if total is None else (total + v if how == "add" else total | v)
        return pd.DataFrame({"part": [int(key[1])], "slice": [int(key[0])], "data": [zipped(total)]})

    for _ in range(math.ceil(math.log(max(2, parts.rdd.getNumPartitions()), 32))):
        parts = parts.groupBy("slice", F.floor(F.col("part") / 32).alias("p")).applyInPandas(merge, "part long, slice int, data binary")
    return {r["slice"]: np.frombuffer(zlib.decompress(r["data"]), dtype) for r in parts.select("slice", "data").collect()}


BITMAP_BITS = 1 << 26
_SLICE = 1 << 17  # bytes


def bitmap_of(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed length with the slot of each hash in the only column of `keys` set: a filter with false positives only."""
    shift = np.uint64(64 - int(math.log2(bits)))

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(bits // 8, np.uint8)
        for b in it:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> shift).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        part = TaskContext.get().partitionId()
        for i in range(0, len(seen), _SLICE):
            if (s := seen[i : i + _SLICE]).any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "slice": pa.array([i // _SLICE], pa.int32()), "data": pa.array([zipped(s)], pa.binary())})

    parts = checkpointed(keys.mapInArrow(fill, "part long, slice int, data binary"))
    out = np.zeros(bits // 8, np.uint8)
    for i, x in merged_slices(parts, "or", "u1").items():
        out[i * _SLICE : i * _SLICE + len(x)] = x
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.view(np.uint64) >> np.uint64(64 - int(math.log2(len(bitmap) * 8)))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
