"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products become least distances: with M the largest norm, x turns into (x, sqrt(M^2 - |x|^2)) / M and a
query into (q, 0) / |q|. A table hashes a point to the cells, `width` wide, of a few Gaussian projections. A query visits
the cells around the place where a neighbour of it is expected, in the order of their estimated success, until the
chances of the cells visited add up to `success`. That place follows from the inner product with the neighbour, and the
query's own nearest in a sample tell what that is: a query in a crowd visits few cells and one by itself many. How many
projections a table has is fitted to the number of rows and their spread: as many as make queries of the sample compare and
visit least. The rows of a bucket are dealt into blocks of bounded size, as are the queries that visit it; a pair of blocks is one matrix
product that leaves each query's nearest, scored by inner products of the original vectors; a task keeps the k nearest of all its
products, so what it tells follows its queries, not the blocks that they visit. Queries that found fewer than k rows, though there are more, are compared with all.

As M is large beside most vectors where a few are long, vectors longer than twice the median are in bands by powers of two, each with
an M, a sample and tables of its own; neighbouring bands with no more rows than a block are that block. Bands are searched from the longest down, and a
query whose k-th score is out of the reach of a band's longest vector doesn't ask there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed
from .vectors import matrix, unit, usable

SAMPLE = 8192  # rows that the index is fitted on: those with the least hashes
_TRIED = 64  # of these, queries that the number of projections is chosen by
_FOUND = 1 << 20  # rows found that a task holds
_VISIT = 64  # a cell costs a query as much as so many rows
_HELD = 1 << 20  # chances that are held at once
_ERF = np.vectorize(math.erf, otypes=[float])
_MISSED = 1e-4  # chance, a projection, that cells out of reach may have


class Hashes:
    """Tables of p-stable hashes, and a sample that tells where a query's neighbours are expected.

    A neighbour whose inner product with the query is c, both of length 1, is projected to c * the query's projection
    and a normal deviate of sqrt(1 - c^2).
    """

    def __init__(self, width: int, peak: float, largest: float, tables: int, projections: int, cell: float, seed: int):
        """peak: the largest component's size, which all are divided by before they are squared; largest: the largest length, so divided."""
        rng = np.random.default_rng(seed)
        self.width = width
        self.axes = rng.normal(size=(width + 1, tables, projections))
        self.shift = rng.uniform(0, cell, (tables, projections))
        self.peak, self.largest, self.cell, self.tables = peak, largest, cell, tables
        self.sample, self.ids, self.nearest = np.zeros((0, width)), np.zeros(0, np.int64), 1

    def _shrunk(self, x: np.ndarray) -> np.ndarray:
        """Vectors of length 1 at most, in proportion."""
        return x / self.peak / self.largest

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(row, table, projection)."""
        x = unit(x) if query else self._shrunk(x)
        last = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
        return np.tensordot(np.hstack([x, last]), self.axes, 1)

    def fit(self, x: np.ndarray, ids: np.ndarray, nearest: int) -> None:
        """x: vectors of different ids, of which so many are a query's nearest."""
        self.sample, self.ids, self.nearest = self._shrunk(x), ids, max(1, min(nearest, len(x) - 1))

    def closeness(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(row, level): inner products that neighbours of the queries x may have: a copy's, and those of the first, middle and last of its nearest in the sample."""
        copy = np.sqrt((self._shrunk(x) ** 2).sum(1, keepdims=True))
        if len(self.sample) < 2:
            return np.clip(copy, -1, 1)
        s = unit(x) @ self.sample.T
        s[ids[:, None] == self.ids[None]] = -np.inf
        top = -np.sort(-np.partition(s, s.shape[1] - self.nearest, 1)[:, -self.nearest :], 1)
        return np.clip(np.hstack([copy, top[:, [0, (self.nearest - 1) // 2, self.nearest - 1]]]), -1, 1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(row, table, projection): the cell of a candidate."""
        return np.floor((self.projected(x, False) + self.shift) / self.cell).astype(np.int64)

    def probes(self, x: np.ndarray, ids: np.ndarray, success: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, row, cell) of the cells that the queries x visit: the likeliest first, until at each level of closeness their chances add up to `success`."""
        close = self.closeness(x, ids)[:, :, None]
        spread = np.maximum(0.05, np.sqrt(1 - close**2))[:, :, :, None]
        for t in range(self.tables):
            at = close * self.projected(x, True)[:, None, t] + self.shift[t]  # (row, level, projection)
            home = np.floor((at.min(1) + at.max(1)) / 2 / self.cell).astype(np.int64)
            reach = 1
            while True:  # as many cells on either side as it takes to have nearly all of every level's chances
                edge = (home[:, None, :, None] + np.arange(-reach, reach + 2)) * self.cell - at[:, :, :, None]
                below = 0.5 + 0.5 * _ERF(edge / (spread * math.sqrt(2)))
                if len(at) == 0 or 1 - (below[..., -1] - below[..., 0]).min() <= _MISSED:
                    break
                reach += 1
            chance = np.diff(below, axis=3)  # (row, level, projection, move)
            moves = np.array(list(itertools.product(range(-reach, reach + 1), repeat=home.shape[1])))
            step = max(1, _HELD // (len(moves) * at.shape[1]))
            for lo in range(0, len(at), step):
                some = chance[lo : lo + step]
                total = np.ones((*some.shape[:2], 1))
                for k in range(home.shape[1]):
                    total = (total[:, :, :, None] * some[:, :, k, None, :]).reshape(*some.shape[:2], -1)
                order = np.argsort(-total.mean(1), 1, kind="stable")
                sorted_ = np.take_along_axis(total, order[:, None], 2)
                row, place = np.nonzero(((np.cumsum(sorted_, 2) - sorted_) < success).any(1))
                yield t, row + lo, home[row + lo] + moves[order[row, place]]


def _nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k nearest of x to each of q, those with q's own id left out, ties to the smaller id."""
    s = q @ x.T
    s[qid[:, None] == xid[None]] = -np.inf
    if len(x) > k:
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        peaks = [np.maximum(np.abs(v).max(1), 5e-324) for v in (q, x)]
        qn, xn = (p * np.sqrt(((v / p[:, None]) ** 2).sum(1)) for v, p in zip((q, x), peaks, strict=True))
        with np.errstate(over="ignore", invalid="ignore"):
            enough = least - 1e-9 * qn * xn.max()
        enough[~np.isfinite(enough)] = -np.inf
        i, j = np.nonzero((s >= enough[:, None]) & (s > -np.inf))
    else:
        i, j = np.nonzero(s > -np.inf)
    score = np.concatenate([np.zeros(0), *((q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536))])
    order = np.lexsort((xid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return qid[i[rank < k]], xid[j[rank < k]], score[rank < k]


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k nearest of each query among all that were found; a row that was found repeatedly counts once, by its best score."""
    qid, xid, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-score, xid, qid))
    qid, xid, score = qid[order], xid[order], score[order]
    first = np.ones(len(qid), bool)
    first[1:] = (qid[1:] != qid[:-1]) | (xid[1:] != xid[:-1])
    qid, xid, score = qid[first], xid[first], score[first]
    order = np.lexsort((xid, -score, qid))
    qid, xid, score = qid[order], xid[order], score[order]
    near = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[near], xid[near], score[near]


def nearest_of_blocks(pairs: Iterator[pa.RecordBatch], width: int, k: int, most: int = _FOUND) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score: each query's k nearest in all these pairs of blocks (qids, q, ids, x).

    No more than about `most` rows are held; with more queries than that allows, what there is so far is told, and their later blocks are told apart.
    """

    def told(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for b in pairs:
        for i in range(b.num_rows):
            qid, q, xid, x = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("qids", "<i8"), ("q", "<f8"), ("ids", "<i8"), ("x", "<f8")))
            q, x = q.reshape(-1, width), x.reshape(-1, width)
            for at in range(0, len(q), 512):
                found.append(_nearest(q[at : at + 512], qid[at : at + 512], x, xid, k))
                held += len(found[-1][0])
                if held > most:
                    found = [_best(found, k)]
                    held = len(found[0][0])
                    if held > most // 2:
                        yield told(found[0])
                        found, held = [], 0
    if found:
        yield told(_best(found, k))


def fit_hashes(rows: DataFrame, k: int, tables: int, projections: tuple[int, ...], cell: float, success: float, seed: int = 7) -> Hashes | None:
    """Hashes for rows (vec_id, v) with a sample of at most SAMPLE of them; None if there are none."""
    n, width, peak = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return None
    largest = rows.agg(F.max(F.aggregate(F.transform("v", lambda x: x / F.lit(peak)), F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas().drop_duplicates("vec_id")
    x, ids = np.zeros((len(few), width)), few["vec_id"].to_numpy()
    for i, v in enumerate(few["v"]):
        x[i, : len(v)] = v

    def cost(h: Hashes) -> float:
        """Rows that a query compares and cells that it visits, these as rows."""
        q, total = x[:_TRIED], 0.0
        for t, row, cells in h.probes(q, ids[:_TRIED], success):
            own, size = np.unique(h.buckets(x)[:, t], axis=0, return_counts=True)
            size_of = dict(zip(map(tuple, own.tolist()), size.tolist(), strict=True))
            total += sum(size_of.get(c, 0) for c in map(tuple, cells.tolist())) * n / len(x) + len(row) * _VISIT
        return total / len(q)

    tried = []
    for p in projections:
        h = Hashes(width, peak, math.sqrt(largest), tables, p, cell, seed)
        h.fit(x, ids, round(k * len(x) / n))
        tried.append((cost(h) if len(projections) > 1 else 0.0, p, h))
    return min(tried, key=lambda t: t[:2])[2]


def _log_length(v: Column) -> Column:
    """Of base 2, which no component's size makes overflow."""
    top = F.array_max(F.transform(v, F.abs))
    return F.log2(top) + F.log2(F.aggregate(F.transform(v, lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x)) / 2


def norm_bands(rows: DataFrame, block: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """rows (vec_id, v) with `level`, 0 below twice the median length and one more for each doubling, and bands (lowest, highest level, rows), the longest first.

    A band is one level, or levels above 0 with at most `block` rows together: so there are no more bands than twice the blocks. Doubles have some 2100 levels.
    """
    middle = rows.agg(F.percentile_approx(_log_length(F.col("v")), 0.5, 1000)).first()[0]
    if middle is None:
        return rows.withColumn("level", F.lit(0)), []
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.floor(_log_length(F.col("v")) - F.lit(middle)).cast("int")))
    bands: list[tuple[int, int, int]] = []
    for level, n in sorted(rows.groupBy("level").count().collect(), reverse=True):
        if bands and level and bands[-1][2] + n <= block:
            bands[-1] = (level, bands[-1][1], bands[-1][2] + n)
        else:
            bands.append((level, level, n))
    return rows, bands


def nearest(vectors: DataFrame, is_query: str, k: int = 20, tables: int = 2, projections: tuple[int, ...] = (3, 4, 5), cell: float = 2.0, success: float = 0.75, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row where the SQL condition is_query holds.

    vectors: vec_id and embedding; other columns are ignored. Nearest is the largest inner product in double precision,
    ties to the smaller vec_id; a shorter vector counts as if zeros followed. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without vec_id, take no part. A query's own vec_id isn't its neighbour, and
    a repeated vec_id is one neighbour, by its best score. Every query gets k rows, or all others if there are fewer.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    leveled, bands = norm_bands(rows, block)
    if not bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = rows.agg(F.max(F.size("v"))).first()[0]

    def emit(owner: np.ndarray, table: np.ndarray, cells: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
        bucket = pa.ListArray.from_arrays(ends, pa.array(cells.astype(np.int32).ravel()))
        owner = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), bucket, b.column("vec_id").take(owner), b.column("v").take(owner)], names=["t", "bucket", "vec_id", "v"])

    def hashed(hashes: Hashes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                cells = hashes.buckets(matrix(b.column("v"), hashes.width)[0])
                n = len(cells)
                yield emit(np.repeat(np.arange(n), tables), np.tile(np.arange(tables), n), cells.reshape(n * tables, -1), b)

        return run

    def probed(hashes: Hashes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for at in range(0, b.num_rows, 128):
                    some = b.slice(at, 128)
                    x = matrix(some.column("v"), width)[0][:, : hashes.width]  # what the band's vectors lack adds nothing
                    for t, row, cells in hashes.probes(x, some.column("vec_id").to_numpy(), success):
                        yield emit(row, np.full(len(row), t), cells, some)

        return run

    schema = "t int, bucket array<int>, vec_id long, v array<double>"
    packed = "t int, bucket array<int>, ids binary, x binary"

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        x, _ = matrix(t.column("v").combine_chunks(), width)
        return pa.table({"t": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.list_(pa.int32())), "ids": pa.array([t.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    def blocks(df: DataFrame) -> DataFrame:
        """Rows of a bucket in blocks of about `block` rows, by hash."""
        counts = df.groupBy("t", "bucket").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
        dealt = df.join(counts, ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
        # Dealt anew: the join may have left all blocks of a bucket in one partition.
        return dealt.repartition("t", "bucket", "block").groupBy("t", "bucket", "block").applyInArrow(pack, packed)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return nearest_of_blocks(it, width, k)

    def compared(pairs: DataFrame) -> DataFrame:
        found = pairs.select("qids", "q", "ids", "x").mapInArrow(compare, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def whole(df: DataFrame, number: int) -> DataFrame:
        """All rows in so many blocks."""
        dealt = df.select(F.lit(0).alias("t"), F.array().cast("array<int>").alias("bucket"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(number)).alias("block"))
        return dealt.groupBy("t", "bucket", "block").applyInArrow(pack, packed).select("ids", "x")

    def few_compared(few: DataFrame, asked: DataFrame) -> DataFrame:
        """All of a band of one block with all queries, which get it whole."""
        held = few.toPandas()
        x, xid = np.zeros((len(held), width)), held["vec_id"].to_numpy()
        for i, v in enumerate(held["v"]):
            x[i, : len(v)] = v

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                q, qid = matrix(b.column("v"), width)[0], b.column("vec_id").to_numpy()
                for at in range(0, len(q), 512):
                    found = _nearest(q[at : at + 512], qid[at : at + 512], x, xid, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

        return asked.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def in_reach(asked: DataFrame, found: DataFrame, longest: float) -> DataFrame:
        """Queries whose k-th score isn't above what a vector of that length, as a logarithm, can have."""
        kth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")) == k
        settled = found.withColumn("kth", kth).where("kth and score > 0").select(F.col("query_id").alias("vec_id"), F.log2("score").alias("kth"))
        return asked.join(settled, "vec_id", "left").where(F.col("kth").isNull() | (F.col("kth") <= _log_length(F.col("v")) + F.lit(longest + 1e-9))).drop("kth")

    asked = rows.where(is_query)
    once = None
    for low, high, number in bands:
        band = rows if len(bands) == 1 else leveled.where(F.col("level").between(low, high)).select("vec_id", "v")
        ask = asked if once is None else in_reach(asked, once, band.agg(F.max(_log_length(F.col("v")))).first()[0])
        if low and number <= block:
            found = few_compared(band, ask)
        else:
            hashes = fit_hashes(band, k, tables, projections, cell, success)
            there = checkpointed(blocks(band.mapInArrow(hashed(hashes), schema)))
            asking = checkpointed(blocks(ask.mapInArrow(probed(hashes), schema)))
            found = compared(asking.toDF("t", "bucket", "qids", "q").join(there, ["t", "bucket"]))
        once = checkpointed(found if once is None else once.union(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    n, ids = rows.agg(F.count("*"), F.countDistinct("vec_id")).first()
    enough = once.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(k, ids - 1))
    short = checkpointed(asked.join(enough, "vec_id", "left_anti"))
    if few := short.count():
        asking = checkpointed(whole(short, math.ceil(few / block)))
        exact = compared(asking.toDF("qids", "q").crossJoin(whole(rows, math.ceil(n / block))))
        once = once.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").union(exact)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
