"""Words of whole texts as 64-bit hashes, computed for all texts of an Arrow batch at once.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over its bytes, taken
as a difference of prefix sums modulo 2^64, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18  # bytes that are hashed at once; each takes 8 in every array of powers, values and sums
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_INVERSE)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len(texts) + 1 offsets into them; a null text is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, words of each text) of the texts that offsets delimit; lower: A-Z count as a-z; kinds: of each byte, words end as well between kinds 1 and 2."""
    value = _LOWER_VALUE if lower else _VALUE
    hashes, starts, ends = [], [], []
    at, stop = int(offsets[0]), int(offsets[-1])
    edge = offsets[(offsets >= at) & (offsets < stop)]
    while at < stop:
        to = min(at + _PIECE, stop)
        if to < stop:  # a piece ends before a space, or where a text ends
            while to < stop and not _SPACE[data[to]]:
                more = np.flatnonzero(_SPACE[data[to : min(to + 4096, stop)]])
                to = to + int(more[0]) if len(more) else min(to + 4096, stop)
        b = data[at:to]
        word = ~_SPACE[b]
        first = np.zeros(len(b) + 1, bool)
        first[0] = first[-1] = True
        lo, hi = np.searchsorted(edge, [at, to])
        first[edge[lo:hi] - at] = True
        if kinds is not None:
            kind = kinds[b]
            first[1:-1] |= kind[1:] + kind[:-1] == 3
        after_space = np.empty(len(b), bool)
        after_space[0] = True
        np.logical_not(word[:-1], out=after_space[1:])
        before_space = np.empty(len(b), bool)
        before_space[-1] = True
        np.logical_not(word[1:], out=before_space[:-1])
        s = np.flatnonzero(word & (after_space | first[:-1]))
        e = np.flatnonzero(word & (before_space | first[1:])) + 1
        if len(s):
            power, inverse = _powers(max(_PIECE, 1 << (len(b) - 1).bit_length()))
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(value[b] * power[: len(b)], out=total[1:])
            h = (total[e] - total[s]) * inverse[s]
            hashes.append(mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts)
    n = np.diff(np.searchsorted(starts, offsets))
    return np.concatenate(hashes), starts, np.concatenate(ends), n


def batches_by_bytes(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles) of every text; fewer than k words make one shingle, none make none."""
    data, offsets = text_buffer(texts)
    for lo, hi in batches_by_bytes(offsets, 1 << 20):
        h, _, _, n = words_of(data, offsets[lo : hi + 1], lower=True)
        if len(h) >= k:
            s = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                s += h[j : len(h) - k + 1 + j] * _STEP[j]
            s = mix(s ^ np.uint64(k))
        at = 0
        for i, m in enumerate(n.tolist()):
            if m >= k:
                yield lo + i, np.unique(s[at : at + m - k + 1])
            elif m:
                yield lo + i, mix(np.array([(h[at : at + m] * _STEP[:m]).sum(dtype=np.uint64) ^ np.uint64(m)]))
            else:
                yield lo + i, np.zeros(0, np.uint64)
            at += m
