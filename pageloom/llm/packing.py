"""Best-fit packing: a grouping genetic algorithm on islands.

Pieces that fill a sequence stand alone. The others are dealt at random into shards of a few thousand, and
every shard is packed by several islands: populations whose crossover injects whole well-filled sequences of
one parent into the other, drops the sequences that hold a duplicate, and puts displaced pieces back by best
fit. Between epochs each island sends its elite to the next one. Shards are independent, so the work grows
with the input; each wastes at most about one sequence against one packing of everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_batches
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Every document's ids and end_id, cut into pieces of `capacity` ids; the last may be shorter. A null text is empty."""

    text_batches(docs.sparkSession)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in it:
            doc = b.column(0).to_pylist()
            for lo, ids, counts in enc.encode(b.column(1)):
                out: list[list] = [[], [], [], [], []]
                at = 0
                for i, n in enumerate(counts.tolist()):
                    own = np.empty(n + 1, "<u4")
                    own[:n] = ids[at : at + n]
                    own[n] = end_id
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        x = own[s : s + capacity]
                        for c, v in zip(out, (doc[lo + i], k, s, len(x), zlib.crc32(x)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], free: list[int], capacity: int) -> list[int]:
    """The bin of each size, in the given order: the open bin with the least room that suffices, else a new one. free: room of the open bins; grows."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for b, r in enumerate(free):
        by_room[r].append(b)
        some |= 1 << r
    out = []
    for s in sizes:
        m = some >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        out.append(b)
        r -= s
        free[b] = r
        by_room[r].append(b)
        some |= 1 << r
    return out


class Island:
    """One population of packings of the same pieces; a packing is the bin of each piece."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.len, self.cap, self.rng = lengths.astype(np.int64), capacity, np.random.default_rng(seed)
        self.bound = max(1, -(-int(self.len.sum()) // capacity))

    def fitness(self, a: np.ndarray) -> tuple[int, float]:
        load = np.bincount(a, self.len)
        return len(load), -float(((load / self.cap) ** 2).sum())

    def _pack(self, order: np.ndarray) -> np.ndarray:
        a = np.empty(len(self.len), np.int32)
        a[order] = best_fit(self.len[order].tolist(), [], self.cap)
        return a

    def first(self, size: int) -> list[np.ndarray]:
        """Best fit by decreasing length, and by lengths that a little noise has put out of order."""
        orders = [np.argsort(-self.len, kind="stable")]
        orders += [np.argsort(-self.len * self.rng.uniform(0.8, 1, len(self.len)), kind="stable") for _ in range(size - 1)]
        return [self._pack(o) for o in orders]

    def _refill(self, kept: list[np.ndarray], loose: np.ndarray) -> np.ndarray:
        """A packing with the kept bins (masks of (bin or -1) per piece, disjoint) and the loose pieces put back by best fit."""
        a, n = np.full(len(self.len), -1, np.int32), 0
        for bins in kept:
            on = bins >= 0
            used, new = np.unique(bins[on], return_inverse=True)
            a[on] = new + n
            n += len(used)
        room = (self.cap - np.bincount(a[a >= 0], self.len[a >= 0], n)).astype(np.int64).tolist()
        loose = loose[np.argsort(-self.len[loose], kind="stable")]
        a[loose] = best_fit(self.len[loose].tolist(), room, self.cap)
        return a

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """b's well-filled bins, some of them, go into a; a's bins that share a piece with them are undone."""
        load = np.bincount(b, self.len)
        good = (load >= np.quantile(load, 0.5)) & (self.rng.random(len(load)) < self.rng.uniform(0.1, 0.5))
        given = good[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[given]] = True
        stays = ~hit[a]
        return self._refill([np.where(given, b, -1), np.where(stays, a, -1)], np.flatnonzero(~given & ~stays))

    def mutate(self, a: np.ndarray) -> np.ndarray:
        """Undoes the emptiest bins and a few others."""
        load = np.bincount(a, self.len)
        out = self.rng.random(len(load)) < 0.04
        out[np.argsort(load)[: max(1, len(load) // 50)]] = True
        return self._refill([np.where(out[a], -1, a)], np.flatnonzero(out[a]))

    def evolve(self, pop: list[np.ndarray], generations: int) -> list[np.ndarray]:
        size = len(pop)
        pop = sorted(pop, key=self.fitness)
        for _ in range(generations):
            if self.fitness(pop[0])[0] <= self.bound:
                break
            i, j = self.rng.choice(size, 2, replace=False)
            pop += [self.cross(pop[0], pop[i]), self.cross(pop[i], pop[j]), self.mutate(pop[0])]
            pop = sorted(pop, key=self.fitness)[:size]
        return pop


STATE = "shard long, island int, lengths binary, pop array<binary>, bins int, uneven double"


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                lengths = np.frombuffer(r.lengths, "<i4")
                isle = Island(lengths, capacity, seed=hash((int(r.shard), int(r.island), epoch)) & 0x7FFFFFFF)
                pop = [np.frombuffer(x, "<i4") for x in r.pop] or isle.first(population)
                guests = [np.frombuffer(x, "<i4") for x in r.guests]
                pop = isle.evolve(sorted(pop + guests, key=isle.fitness)[:population], generations)
                n, uneven = isle.fitness(pop[0])
                yield pd.DataFrame({"shard": [r.shard], "island": [r.island], "lengths": [r.lengths], "pop": [[x.astype("<i4").tobytes() for x in pop]], "bins": [n], "uneven": [uneven]})

    return run


def pack_pieces(pieces: DataFrame, capacity: int, shard_pieces: int = 8192, islands: int = 2, epochs: int = 2, population: int = 5, generations: int = 8, elite: int = 1) -> DataFrame:
    """pieces (any columns, with `length` from 1 to capacity) plus sequence_id and offset; every row is placed once. Columns of these two names are replaced; an empty table gives no rows."""
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = checkpointed(pieces.select("length", F.struct(*own).alias("row")))
    cols = pieces.columns
    whole = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))
    # A checkpoint's partitions are fixed, so a row's number is the same whenever a lost part is computed again.
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    items = checkpointed(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", *[c for c in cols if c != "length"]))).alias("items")))

    def packed_lengths(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"shard": pdf["shard"], "lengths": [np.asarray(x, "<i4").tobytes() for x in pdf["n"]]})

    tasks = shards * islands if shards * islands <= 1000 else max(1000, shards * islands // 64)
    start = items.select("shard", F.col("items.length").alias("n")).mapInPandas(packed_lengths, "shard long, lengths binary")
    state = start.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("pop", F.array().cast("array<binary>")).withColumn("guests", F.array().cast("array<binary>"))
    for epoch in range(epochs):
        state = checkpointed(state.repartition(tasks, "shard", "island").mapInPandas(_epoch(capacity, population, generations, epoch), STATE))
        sent = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("pop", 1, elite).alias("guests"))
        if epoch + 1 < epochs:
            state = state.drop("bins", "uneven").join(sent, ["shard", "island"])

    def placed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            bins, offsets = [], []
            for lengths, best in zip(pdf["lengths"], pdf["best"], strict=True):
                n, a = np.frombuffer(lengths, "<i4").astype(np.int64), np.frombuffer(best, "<i4")
                order = np.argsort(a, kind="stable")
                before = np.cumsum(n[order]) - n[order]
                first = np.flatnonzero(np.diff(a[order], prepend=-1))
                at = np.empty(len(n), np.int64)
                at[order] = before - np.repeat(before[first], np.diff(np.append(first, len(n))))
                bins.append(a.astype(np.int64))
                offsets.append(at)
            yield pd.DataFrame({"shard": pdf["shard"], "bins": bins, "offsets": offsets})

    best = state.groupBy("shard").agg(F.min_by(F.struct("lengths", F.col("pop")[0].alias("best")), F.struct("bins", "uneven", "island")).alias("x")).select("shard", "x.lengths", "x.best")
    best = best.mapInPandas(placed, "shard long, bins array<long>, offsets array<long>")
    rows = items.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "bins", "offsets")).alias("x"))
    rows = rows.select(*[F.col("x.items")[c].alias(c) for c in cols], (F.col("shard") * F.lit(1 << 24) + F.col("x.bins")).alias("sequence_id"), F.col("x.offsets").alias("offset"))
    return rows.unionByName(whole).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Repeated rows are packed as often as they occur;
    other columns of docs are ignored; an empty table gives no rows.
    """
    return pack_pieces(tokenized_pieces(docs, tokenizer_path, capacity), capacity, **options)
