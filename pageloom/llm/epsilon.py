"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within epsilon = sqrt(2 - 2c) of each other. Vectors are sorted by the
cells, epsilon wide, of a grid on their leading principal dimensions. Intervals of that sequence are joined
recursively from the whole down: a pair of intervals is split into pairs of their parts, and every pair whose boxes
are farther apart than epsilon is skipped, which loses nothing. The last intervals, blocks of a fixed number of
vectors, are compared by matrix products, again without the stretches whose boxes are too far apart.

Equal vectors are one class and compared once. A comparison of two blocks returns counts and a spanning forest of the
links found, never the pairs, so a large group of near copies costs no more rows than it has vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, connected_components, merged_slices, zipped
from .vectors import matrix, unit, usable

_BOX = 12  # principal dimensions that boxes have
_CELLS = 8  # leading ones of these that the order uses
_LEAF = 128
_PCA = 512  # components that the principal dimensions are made of, at most
_FAN = 8


def principal_dimensions(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, most variance first, over the first _PCA components of all unit vectors of the column `v`."""
    d = min(width, _PCA)

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((d + 1, d + 1))
        for b in it:
            for k in range(0, b.num_rows, 4096):
                x, _ = matrix(b.column("v").slice(k, 4096), width)
                x = np.hstack([np.ones((len(x), 1)), unit(x)[:, :d]])
                total += x.T @ x
        if total[0, 0]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "slice": pa.array([0], pa.int32()), "data": pa.array([zipped(total)], pa.binary())})

    got = merged_slices(checkpointed(vectors.select("v").mapInArrow(moments, "part long, slice int, data binary")), "add", "<f8")[0].reshape(d + 1, d + 1)
    mean = got[0, 1:] / got[0, 0]
    _, basis = np.linalg.eigh(got[1:, 1:] / got[0, 0] - np.outer(mean, mean))
    basis = basis[:, ::-1][:, :_BOX]
    return np.vstack([basis, np.zeros((width - d, basis.shape[1]))])


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the nodes i[k] and j[k] have been joined, for all k; a label is the least node of its tree."""
    a, b = label[i], label[j]
    apart = a != b
    if not apart.any():
        return label
    root = np.arange(len(label))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    while (up := root[root] != root).any():
        root[up] = root[root[up]]
    return root[label]


def _compare(a: dict, b: dict | None, basis: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other vectors linked, least node linked to it) of two blocks' nodes, or of one block's own."""
    limit = 2 - 2 * cosine + 1e-9
    x, na = a["x"], len(a["x"])
    y, weight_b, size_b, shift = (x, a["m"], a["n"], 0) if b is None else (b["x"], b["m"], b["n"], na)
    nodes = na if b is None else na + len(y)
    links, label = np.zeros(nodes, np.int64), np.arange(nodes)

    def boxes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(v), _LEAF)
        p = v @ basis
        return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)

    (alo, ahi), (blo, bhi) = boxes(x), boxes(y)
    gap = np.maximum(0, np.maximum(alo[:, None] - bhi[None], blo[None] - ahi[:, None]))
    near = (gap * gap).sum(2) <= limit
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    plain = (a["n"] == a["n"][0]).all() and (size_b == a["n"][0]).all()
    for p, q in zip(*np.nonzero(near), strict=True):
        if b is None and q < p:
            continue
        i, j = slice(p * _LEAF, min((p + 1) * _LEAF, na)), slice(q * _LEAF, (q + 1) * _LEAF)
        if (x4[i] @ y4[j].T).max() < cosine - 1e-4:
            continue
        hit = x[i] @ y[j].T >= cosine
        if not plain:
            hit &= a["n"][i][:, None] == size_b[j][None]
        if b is None and p == q:
            hit = np.triu(hit, 1)
        if hit.any():
            links[i] += hit @ weight_b[j]
            links[shift + q * _LEAF : shift + q * _LEAF + hit.shape[1]] += a["m"][i] @ hit
            r, c = np.nonzero(hit)
            label = _forest(label, r + p * _LEAF, c + q * _LEAF + shift)
    found = np.flatnonzero(links)
    return found, links[found], label[found]


def epsilon_join(vectors: DataFrame, cosine: float = 0.95, block: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding; other columns are ignored).

    Rows link when the cosine of their vectors, in double precision, is at least `cosine`; n_links counts the other
    rows linked directly, component_id is the least vec_id reachable (its own, if none; null vec_ids come last), kept
    says whether that is its own. Vectors of different lengths don't link. A null, empty or zero vector, or one with
    null or non-finite components, links with nothing. Repeated rows are rows of their own that link with each other.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), usable(F.col("embedding")).alias("ok"))
    good = rows.where("ok").select("vec_id", "v", F.xxhash64("v").alias("h"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = checkpointed(good.groupBy("h").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v")))
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    links = _links(classes, n, width, cosine, block)
    reach = connected_components(links.where("h != root").select("h", "root"), "h", "root").toDF("h", "c")
    counted = links.groupBy("h").agg(F.sum("links").alias("links"))
    info = classes.select("h", "least", "m").join(counted, "h", "left").join(reach, "h", "left").withColumn("c", F.coalesce("c", "h"))
    info = info.join(info.groupBy("c").agg(F.min("least").alias("component_id")), "c")
    info = info.select("h", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = good.select("vec_id", "h").join(info, "h").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, n: int, width: int, cosine: float, block: int) -> DataFrame:
    """(h, links, root): of a class, rows of other classes that it links with, and a class that those links reach; several rows a class."""
    spark = classes.sparkSession
    basis = principal_dimensions(classes, width)  # fixed size: width * _BOX
    epsilon = math.sqrt(max(2 - 2 * cosine, 1e-12))
    dims = basis.shape[1]

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, size = matrix(b.column("v"), width)
            cell = np.floor(unit(x) @ basis[:, :_CELLS] / epsilon).astype(np.int32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * cell.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("m"), b.column("v"), pa.ListArray.from_arrays(ends, pa.array(cell.ravel()))], names=["h", "m", "v", "cell"])

    placed = classes.select("h", "m", "v").mapInArrow(cells, "h long, m long, v array<double>, cell array<int>")
    parts = max(1, -(-n // (2 * block)))
    line = checkpointed(placed.repartitionByRange(parts, "cell", "h").sortWithinPartitions("cell", "h").drop("cell"))
    # Numbers along the sequence: a row's place in its partition, after the rows of all partitions before it.
    own = F.monotonically_increasing_id()
    line = line.withColumn("part", F.shiftright(own, 33)).withColumn("at", own.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = line.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    line = line.join(before, "part").withColumn("seq", F.col("before") + F.col("at")).withColumn("block", F.floor(F.col("seq") / block))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("seq").combine_chunks()
        x, size = matrix(t.column("v").combine_chunks(), width)
        p = unit(x) @ basis
        box = {f"lo{k}": [float(p[:, k].min())] for k in range(dims)} | {f"hi{k}": [float(p[:, k].max())] for k in range(dims)}
        data = {"x": x.tobytes(), "n": size.astype("<i4").tobytes(), "m": t.column("m").to_numpy().astype("<i8").tobytes(), "h": t.column("h").to_numpy().astype("<i8").tobytes()}
        return pa.table({"id": [key[0].as_py()]} | box | {k: pa.array([b], pa.binary()) for k, b in data.items()})

    bounds = ", ".join(f"{s}{k} double" for s in ("lo", "hi") for k in range(dims))
    blocks = checkpointed(line.select("block", "seq", "h", "m", "v").groupBy("block").applyInArrow(pack, f"id long, {bounds}, x binary, n binary, m binary, h binary"))
    pairs = _near_intervals(blocks.select("id", *[f"{s}{k}" for s in ("lo", "hi") for k in range(dims)]), -(-n // block), dims, 2 - 2 * cosine + 1e-9)

    def side(b: pa.RecordBatch, s: str, k: int) -> dict:
        raw = {c: np.frombuffer(b.column(f"{s}{c}")[k].as_buffer(), t) for c, t in (("x", "<f8"), ("n", "<i4"), ("m", "<i8"), ("h", "<i8"))}
        return raw | {"x": unit(raw["x"].reshape(-1, width))}

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                a = side(batch, "a", k)
                b = None if batch.column("a")[k] == batch.column("b")[k] else side(batch, "b", k)
                h = a["h"] if b is None else np.concatenate([a["h"], b["h"]])
                node, links, root = _compare(a, b, basis, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(h[node]), pa.array(links), pa.array(h[root])], names=["h", "links", "root"])

    data = blocks.select("id", "x", "n", "m", "h")
    full = pairs.join(data.toDF("a", "ax", "an", "am", "ah"), "a").join(data.toDF("b", "bx", "bn", "bm", "bh"), "b")
    return checkpointed(full.mapInArrow(compare, "h long, links long, root long"))


def _near_intervals(blocks: DataFrame, n: int, dims: int, limit: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are near enough, found from the whole sequence down through intervals of _FAN parts each."""
    levels = [blocks]
    while n > 1:
        up = levels[-1].withColumn("id", F.floor(F.col("id") / _FAN))
        box = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(dims)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(dims)]
        levels.append(checkpointed(up.groupBy("id").agg(*box)))
        n = -(-n // _FAN)
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        x, y = (level.select(F.floor(F.col("id") / _FAN).alias(f"{s}_up"), *[F.col(c).alias(f"{s}_{c}") for c in level.columns]) for s in ("a", "b"))
        met = pairs.toDF("a_up", "b_up").join(x, "a_up").join(y, "b_up").where("a_id <= b_id")
        apart = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(dims)]
        near = sum((g * g for g in apart[1:]), apart[0] * apart[0]) <= limit
        pairs = checkpointed(met.where(near).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return pairs
