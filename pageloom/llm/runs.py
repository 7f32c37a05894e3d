"""Periodic runs of words: stretches that repeat with a period at least twice, each extended as far as it goes.

Windows of 2 ** k words get names, level by level: a window's name is that of the pair of its halves' names, so equal
names are equal windows of one text, without hashes and without sorting suffixes. Names that occur once in a text match
nothing and are not carried on. For each period, positions on a grid that every run of that period must touch are
compared with those one period further; where they agree, the longest common extensions both ways come from names of
descending levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches
from .words import batches_by_bytes, text_buffer

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AT_ONCE = 1 << 20  # grid positions compared at once

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each text) in bytes, of the texts that offsets delimit; no word reaches from one text into the next."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    word = ~_SPACE[data[lo:hi]]
    first = np.zeros(hi - lo + 1, bool)
    first[offsets - lo] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts) + lo, np.flatnonzero(ends) + lo + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """A number for each different key, -1 for keys that occur once."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    return np.where(count > 1, rank, -1)[name].astype(np.int32)


def window_names(words: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The names of the windows of 1, 2, 4, ... words at each position, -1 where no other window of the same text is equal.

    words: codes of the words of all texts, n: how many each text has. The last level is the last one with a name; every
    level has an entry more, which is -1. A level takes 4 bytes a word, and there are at most log2 of the longest text's words.
    """
    text, end = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n)
    top = _repeated(text * (int(words.max(initial=0)) + 1) + words)
    levels = []
    while (top >= 0).any():
        levels.append(np.append(top, np.int32(-1)))
        half = 1 << (len(levels) - 1)
        at = np.flatnonzero(top >= 0)
        at = at[at + 2 * half <= end[at]]
        at = at[top[at + half] >= 0]
        below, top = top, np.full(len(top), -1, np.int32)
        top[at] = _repeated(below[at].astype(np.int64) * (int(below.max(initial=0)) + 1) + below[at + half])
    return levels


def _forward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a and from b on agree; b lies behind a in the same text."""
    end = len(levels[0]) - 1
    length = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        x, y = np.minimum(a + length, end), np.minimum(b + length, end)
        same = (levels[k][x] >= 0) & (levels[k][x] == levels[k][y])
        length += same.astype(np.int64) << k
    return length


def _backward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a and before b agree."""
    end = len(levels[0]) - 1
    length = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        x, y = a - length - (1 << k), b - length - (1 << k)
        x, y = np.where(x < 0, end, x), np.where(y < 0, end, y)
        same = (levels[k][x] >= 0) & (levels[k][x] == levels[k][y])
        length += same.astype(np.int64) << k
    return length


def runs_of(words: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all texts, in order of start and end, as positions among all words.

    A run of period p has a stretch of at least max(p, least - p) positions that agree with those p further, so multiples
    of that number touch each one. A multiple of a run's smallest period gives the same stretch; the smallest one stays.
    """
    levels = window_names(words, n)
    none = np.zeros(0, np.int64)
    if not levels:
        return none, none, none
    base = np.cumsum(n) - n
    periods = np.where(n >= least, n // 2, 0)  # p from 1 to half the words
    ends = np.cumsum(periods)
    found = []
    from_pair, pairs = 0, int(ends[-1])
    while from_pair < pairs:
        to_pair = min(from_pair + _AT_ONCE, pairs)
        pair = np.arange(from_pair, to_pair)
        text = np.searchsorted(ends, pair, "right")
        p = pair - (ends - periods)[text] + 1
        step = np.maximum(p, least - p)
        count = (n[text] - p + step - 1) // step
        total = np.cumsum(count)
        if total[-1] > _AT_ONCE:  # as many pairs as that allows, one at least
            keep = max(1, int(np.searchsorted(total, _AT_ONCE, "right")))
            text, p, step, count, total, to_pair = text[:keep], p[:keep], step[:keep], count[:keep], total[:keep], from_pair + keep
        from_pair = to_pair
        at = np.arange(total[-1]) - np.repeat(total - count, count)
        at = at * np.repeat(step, count) + np.repeat(base[text], count)
        p = np.repeat(p, count)
        x = levels[0][at]
        hit = np.flatnonzero((x >= 0) & (x == levels[0][at + p]))
        at, p = at[hit], p[hit]
        back, on = _backward(levels, at, at + p), _forward(levels, at, at + p)
        start, end = at - back, at + on + p
        good = (end - start >= least) & (end - start >= 2 * p)
        found.append(_smallest(start[good], end[good], p[good]))
    return _smallest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (none, none, none)


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each start and end, with the smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _examined(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(words of each text, its runs, the text collapsed) of the texts that offsets delimit."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, ends, n = word_bounds(data, offsets)
    dense = data[lo:hi][~_SPACE[data[lo:hi]]]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(dense)])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    start, end, period = runs_of(codes, n, least)
    base = np.cumsum(n) - n
    text = np.searchsorted(base + n, start, "right")
    fields = [pa.array(x, pa.int64()) for x in (start - base[text], end - start, period)]
    bounds = np.searchsorted(text, np.arange(len(n) + 1))
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ARROW_RUNS.value_type)), type=_ARROW_RUNS)

    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    own = np.searchsorted(base + n, keep, "right")
    kept = np.zeros(hi - lo + 1, np.int32)
    np.add.at(kept, starts[keep] - lo, 1)
    np.add.at(kept, ends[keep] - lo, -1)
    mask = np.cumsum(kept[:-1]) > 0
    gap = ends[keep[:-1]][own[:-1] == own[1:]] - lo  # the byte behind a word that another one follows is a space or the like
    copy = data[lo:hi].copy()
    copy[gap] = 0x20
    mask[gap] = True
    sizes = np.concatenate([[0], np.cumsum(mask)])[offsets - lo]
    collapsed = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(copy[mask])])
    return pa.array(n, pa.int64()), runs, collapsed.cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = 12, text: str = "text") -> DataFrame:
    """docs with n_words, runs and collapsed added; columns of docs that bear these names are replaced, all others stay.

    runs: array of (start, length, period), by start, then length: each stretch of consecutive words, numbered from 0, whose
    smallest period is `period`, that has at least max(least, 2 * period) words and that no neighbouring word extends. Words are
    runs of characters other than space and 0x09-0x0D, compared as they are. collapsed: the words that remain, joined by one
    space, when each run's words behind its first period are dropped. A null or empty text, or one of blanks, has no word, no run
    and collapses to an empty text. Rows don't see each other: repeated rows give repeated results, an empty table an empty one.

    Texts are worked on in their rows' order, about 4 MB at once; a longer one is a batch of its own and takes some 60 bytes
    a word, and 4 more for each power of two up to its longest repeated stretch.
    """
    text_batches(docs.sparkSession)
    made, which = ("n_words", "runs", "collapsed"), docs.columns.index(text)
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def examine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = text_buffer(batch.column(0).field(which).cast(pa.string()))
            for lo, hi in batches_by_bytes(offsets):
                columns = [batch.column(0).slice(lo, hi - lo), *_examined(data, offsets[lo : hi + 1], least)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *made])

    out = docs.select(F.struct("*").alias("row")).mapInArrow(examine, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in made], *made)
