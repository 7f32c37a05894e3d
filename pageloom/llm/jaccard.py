"""N-gram Jaccard join: the product of the sparse document-by-n-gram matrix with its transpose, in blocks of columns.

Columns (n-grams) are put in one fixed order, those that look rare first. Two documents that are similar
enough must meet in the first columns of each: a size-derived prefix. So the product is taken block by block. The first
block is the prefix columns: its sparse product gives the pairs that meet there, with an overlap so far and the last place
where they met. A pair is discarded if that overlap and all that could still follow stay below what the two sizes require.
For the pairs that are left, the overlaps of all blocks of columns (ranges of hashes, more of them for larger sets) are
computed and accumulated, and the sum decides.

Classes of equal n-gram sets count as one row of the matrix. Within a column, rows are first held against the one
whose position there is least; only the others, where they stay unconnected after that, are held against each other, so a
large group of near copies costs a few comparisons a row and not one for each pair, and a column of two rows is done at once. Of two rows of a column, the
smaller one must have it in an even shorter prefix, so rows that share a template just below the threshold don't meet.
Every pair that is similar enough is compared or connected already, hence the components are exact (up to 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bitmap_of, checkpointed, connected_components, in_bitmap, in_text_batches, merged_slices, stored, zipped
from .words import mix, shingle_sets

_SLOTS = 1 << 21  # counters of the sketch that orders columns; it changes speed, never results
_SLICE = 1 << 15
_COLUMNS = 4096  # members of a set that a block of columns has, about
_HOT, _SALTS = 4096, 16  # a column with so small a part of all entries is hot, hence there are no more of them; its products are dealt over so many tasks
PAIR = [f"{x}.{c} as {y}{x}" for x in "ab" for c, y in (("sig", ""), ("n", "n"), ("key", "k"))]
_SALT = np.uint64(0xA5A5A5A5A5A5A5A5)


def _signature(u: np.ndarray) -> int:
    """The same for equal sets: a sum of mixed members, with the size."""
    return int((mix(u ^ _SALT).sum(dtype=np.uint64) ^ np.uint64(len(u))).view(np.int64))


def required(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of these sizes that are similar enough: 100 * i >= percent * (a + b - i)."""
    return F.ceil((F.lit(percent) * (a + b)) / F.lit(100 + percent) - F.lit(1e-9)).cast("long")


def _signatures(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(key, doc_id, n, sig) of every row, and how often each slot of n-grams occurs: four times its binary logarithm."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(_SLOTS, np.int64)
        names = ["key", "doc_id", "n", "sig", "part", "slice", "data"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in it:
            n, sig, waiting, held = [], [], [], 0
            for _, u in shingle_sets(b.column(2), words):
                n.append(len(u))
                sig.append(_signature(u))
                waiting.append(u)
                held += len(u)
                if held > 1 << 20:
                    counts += np.bincount((np.concatenate(waiting) >> np.uint64(43)).astype(np.int64), minlength=_SLOTS)
                    waiting, held = [], 0
            if held:
                counts += np.bincount((np.concatenate(waiting) >> np.uint64(43)).astype(np.int64), minlength=_SLOTS)
            none = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip((n, sig, none, none, none), types[2:], strict=True)]], names=names)
        part, small = TaskContext.get().partitionId(), np.minimum(counts, 65535).astype("<u2")
        for i in range(0, _SLOTS, _SLICE):
            if small[i : i + _SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, part, i // _SLICE, zipped(small[i : i + _SLICE].astype("<i8"))), types, strict=True)], names=names)

    got = checkpointed(docs.mapInArrow(run, "key long, doc_id long, n long, sig long, part long, slice int, data binary"))
    total = np.zeros(_SLOTS, np.int64)
    for i, x in merged_slices(got.where("part is not null").select("part", "slice", "data"), "add", "<i8").items():
        total[i * _SLICE : (i + 1) * _SLICE] = x
    rank = np.round(np.log2(total + 1) * 4).astype(np.uint8)
    return got.where("part is null").select("key", "doc_id", "n", "sig"), rank


def _prefixes(docs: DataFrame, words: int, percent: int, rank, rows, columns=None) -> DataFrame:
    """(g, sig, n, pos, key) for the prefix columns of the rows in the bitmap `rows`; of these columns, those in the bitmap `columns`."""
    names = ["g", "sig", "n", "pos", "key"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for b in it:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = in_bitmap(rows.value, keys)
            keys = keys[wanted]
            out: list[tuple] = []
            size = 0
            for row, u in shingle_sets(b.column(2).filter(pa.array(wanted)), words):
                n = len(u)
                if not n:
                    continue
                p = n - -(-percent * n // 100) + 1
                first = np.lexsort((u, order[(u >> np.uint64(43)).astype(np.int64)]))[:p]
                g, pos = u[first].view(np.int64), np.arange(p)
                if columns is not None:
                    at = in_bitmap(columns.value, g)
                    g, pos = g[at], pos[at]
                out.append((g, np.full(len(g), _signature(u)), np.full(len(g), n), pos, np.full(len(g), keys[row])))
                size += len(g)
                if size > 1 << 18 or len(out) >= 4096:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    return docs.mapInArrow(run, "g long, sig long, n long, pos long, key long")


def _level(n: int | Column) -> int | Column:
    """How finely the columns are cut for a set of n members: into 4 ** level blocks."""
    steps = [n > _COLUMNS * 4**k for k in range(12)]
    return sum((x.cast("int") for x in steps), F.lit(0)) if isinstance(n, Column) else sum(steps)


def _blocks(docs: DataFrame, words: int, percent: int, rows) -> DataFrame:
    """(key, sig, level, block, members): the rows of the matrix that the bitmap `rows` asks for, cut into blocks of columns.

    A pair is cut as the larger of the two sets, so a set is cut as it would be itself and as the largest one that may match it.
    Rows that share key and set come once from each task.
    """
    names, types = ["key", "sig", "level", "block", "members"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in it:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = in_bitmap(rows.value, keys)
            keys = keys[wanted].tolist()
            out: list[tuple] = []
            size = 0
            for row, u in shingle_sets(b.column(2).filter(pa.array(wanted)), words):
                if not len(u):
                    continue
                sig = _signature(u)
                if (keys[row], sig) in seen:
                    continue
                seen.add((keys[row], sig))
                for level in range(_level(len(u)), _level(len(u) * 100 // percent) + 1):
                    cut = np.searchsorted(u, np.arange(1, 4**level, dtype=np.uint64) << np.uint64(64 - 2 * level)) if level else np.zeros(0, np.int64)
                    out += [(keys[row], sig, level, k, x.tobytes()) for k, x in enumerate(np.split(u, cut)) if len(x)]
                    size += len(u)
                if size > 1 << 20:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    return docs.mapInArrow(run, "key long, sig long, level int, block int, members binary")


def _overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each pair (a, b) in one block of columns, for many pairs at once."""

    def flat(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = pc.binary_length(c).to_numpy() // 8
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64), np.repeat(np.arange(len(n)), n)

    for b in it:
        for lo in range(0, b.num_rows, 512):
            some = b.slice(lo, 512)
            (x, i), (y, j) = flat(some.column("xs")), flat(some.column("ys"))
            g, pair = np.concatenate([x, y]), np.concatenate([i, j])
            order = np.lexsort((g, pair))
            g, pair = g[order], pair[order]
            met = pair[1:][(g[1:] == g[:-1]) & (pair[1:] == pair[:-1])]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("a", "b", "need", "block")), pa.array(np.bincount(met, minlength=some.num_rows))], names=["a", "b", "need", "block", "overlap"])


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, is_first of every row of docs (columns doc_id and text; others are ignored).

    A row's set is its distinct shingles of `words` words, A-Z as a-z; fewer words are one shingle; a null text or
    one without words has the empty set and is linked with nothing. Rows link when 100 * intersection >= percent *
    union. component_id is the least doc_id reachable (a null doc_id counts last). is_first marks one row of
    each component: of rows that share the least doc_id, all are marked; of an unlinked row, itself.
    row: a column with a hash of each row; then it comes too, and `component`, which tells apart components that share
    their least doc_id and is null for the empty set.
    """
    docs = docs.select((F.col(row) if row else F.xxhash64("doc_id")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    with in_text_batches(docs.sparkSession):
        rows, classes, reach = _classes_and_links(docs, words, percent)
    label = classes.join(reach, "sig", "left").withColumn("c", F.coalesce("c", "sig"))
    least = label.groupBy("c").agg(F.min("least").alias("component_id"))
    label = label.join(least, "c").select("sig", "n", "component_id", "c")
    own = [F.col("key").alias(row), F.col("c").alias("component")] if row else []
    out = rows.where("n > 0").join(label, ["sig", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *own)
    alone = rows.where("n = 0").withColumn("c", F.lit(None).cast("long"))
    out = out.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *own))
    return out.withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _classes_and_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: key, doc_id, n, sig; classes: sig, n, key, least doc_id; reach: sig, c), all from checkpoints."""
    rows, rank = _signatures(docs, words)
    classes = checkpointed(rows.where("n > 0").groupBy("sig", "n").agg(F.min("key").alias("key"), F.min("doc_id").alias("least")))
    sent = []

    def send(value):
        sent.append(docs.sparkSession.sparkContext.broadcast(value))  # of fixed size
        return sent[-1]

    rank = send(rank)
    one_each = send(bitmap_of(classes.select("key")))
    # Columns are counted over one row of each class; a row more, that shares a slot, makes a column count as shared for nothing.
    met = _prefixes(docs, words, percent, rank, one_each).groupBy("g").agg(F.count("*").alias("rows"))
    shared = send(bitmap_of(met.where("rows > 1").select("g")))
    entries = _prefixes(docs, words, percent, rank, one_each, shared).groupBy("g", "sig", "n").agg(F.min("pos").alias("pos"), F.min("key").alias("key"))
    column = W.partitionBy("g")
    near = lambda n, pos, m, q: (n - pos >= required(n, m, percent)) & (m - q >= required(n, m, percent))
    of = lambda r="": F.struct(*[F.col(r + c).alias(c) for c in ("sig", "n", "key")])

    def beside(df: DataFrame, **told: Column) -> DataFrame:
        """df with what these aggregates tell of its columns; those of hot columns (`hot`), _HOT at most, come by broadcast, so none of them is one task."""
        few = df.where("hot").groupBy("g").agg(*[x.alias(c) for c, x in told.items()])
        return df.where("not hot").withColumns({c: x.over(column) for c, x in told.items()}).unionByName(df.where("hot").join(F.broadcast(few), "g"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, na, ka, b, nb, kb), those whose overlap, accumulated over all blocks of columns, is what their sizes require."""
        cut = pairs.withColumn("need", required(F.col("na"), F.col("nb"), percent)).withColumn("level", _level(F.greatest("na", "nb")))
        cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0), F.pow(F.lit(4), F.col("level")).cast("int") - 1)))
        for x, members in (("a", "xs"), ("b", "ys")):
            blocks = _blocks(docs, words, percent, send(bitmap_of(pairs.select(f"k{x}"))))
            on = [f"k{x}", x, "level", "block"]
            cut = cut.join(blocks.toDF(*on, members), on)
        parts = cut.select("a", "b", "need", "block", "xs", "ys").mapInArrow(_overlaps, "a long, b long, need long, block int, overlap long")
        parts = parts.groupBy("a", "b", "need", "block").agg(F.max("overlap").alias("overlap"))  # a row may have come from several tasks
        return checkpointed(parts.groupBy("a", "b", "need").agg(F.sum("overlap").alias("overlap")).where("overlap >= need").select("a", "b"))

    def headed() -> DataFrame:
        """The entries of shared columns, with the row that comes first there (h), if the two may match; `first` is that row itself."""
        with stored(entries) as all_entries:
            total = all_entries.count()
            hot = checkpointed(all_entries.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") * _HOT >= F.lit(total)).select("g", F.lit(True).alias("hot")))
            marked = all_entries.join(F.broadcast(hot), "g", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
            rows = beside(marked, h=F.min(F.struct("pos", "n", "sig", "key")), rows=F.count("*")).where("rows > 1").withColumn("first", F.col("sig") == F.col("h.sig"))
            rows = rows.withColumn("h", F.when(~F.col("first") & near(F.col("n"), F.col("pos"), F.col("h.n"), F.col("h.pos")), F.col("h"))).where("rows > 2 or h is not null")
            return stack.enter_context(stored(rows))

    with ExitStack() as stack:
        # In each column, every row against the one that comes first there: the least edited of a group of copies.
        rest = headed()
        pairs = rest.where("h is not null").select(F.greatest(of(), of("h.")).alias("a"), F.least(of(), of("h.")).alias("b")).selectExpr(*PAIR).distinct()
        pairs = checkpointed(pairs)
        reach = checkpointed(connected_components(linked(pairs), "a", "b").toDF("sig", "c"))

        # What is left in a column: rows that aren't connected yet, without the first, which has met all others. So columns of two rows are done.
        # Those of the component that the first row has don't meet each other.
        left = rest.where("rows > 2").select("g", "hot", "first", "sig", "n", "pos", "key").join(reach, "sig", "left").withColumn("c", F.coalesce("c", "sig"))
        others = F.when(~F.col("first"), F.col("c"))
        left = beside(left, lo=F.min(others), hi=F.max(others), main=F.min(F.struct("pos", "n", "sig", "c"))).where("lo < hi and not first")
        left = stack.enter_context(stored(left.select("g", "hot", F.struct("sig", "n", "key", "pos", "c").alias("x"), (F.col("c") == F.col("main.c")).alias("in_main"))))
        # The smaller row of a pair must have the column in the prefix for rows of its own size.
        large, small = left.withColumnRenamed("x", "l"), left.where(F.col("x.n") - F.col("x.pos") >= required(F.col("x.n"), F.col("x.n"), percent)).withColumnRenamed("x", "s")
        order = F.struct("l.n", "l.sig") > F.struct("s.n", "s.sig")
        close = near(F.col("l.n"), F.col("l.pos"), F.col("s.n"), F.col("s.pos"))
        # In a hot column, the rows outside the main component go to every salt, and those that they are held against to one.
        each = lambda df, x: df.select("g", x, F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        dealt = lambda df, x: df.select("g", x, F.when(F.col("hot"), F.pmod(F.xxhash64(f"{x}.sig"), F.lit(_SALTS)).cast("int")).otherwise(0).alias("salt"))
        sides = ((each(large.where("not in_main"), "l"), dealt(small, "s")), (dealt(large.where("in_main"), "l"), each(small.where("not in_main"), "s")))
        meets = [x.join(y, ["g", "salt"]).where(order & (F.col("l.c") != F.col("s.c")) & close) for x, y in sides]
        # What a pair has not met in here lies behind: where it is close, it is among the pairs of first rows.
        met = meets[0].union(meets[1]).groupBy(of("l.").alias("l"), of("s.").alias("s")).agg(F.count("*").alias("overlap"), F.max("l.pos").alias("lp"), F.max("s.pos").alias("sp"))
        most = F.col("overlap") + F.least(F.col("l.n") - F.col("lp"), F.col("s.n") - F.col("sp")) - 1
        more = met.where(most >= required(F.col("l.n"), F.col("s.n"), percent)).select(F.greatest("l", "s").alias("a"), F.least("l", "s").alias("b")).selectExpr(*PAIR)
        more = checkpointed(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        ends = reach.select(F.col("sig").alias("a"), F.col("c").alias("b"))
        reach = checkpointed(connected_components(ends.union(linked(more)), "a", "b").toDF("sig", "c"))
    for x in sent:
        x.destroy()
    return rows, classes, reach
