"""Token ids of whole texts by the public tokenizer whose pre-tokenizer drops white space.

No token of that vocabulary crosses white space, so the ids of a text are those of its words in a row. None joins a letter to
a full stop or the like either, so words are cut there: "word", "word," and "(word)" share what is kept.
Each Python worker keeps the ids of the words that it has met; only new words reach the tokenizer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .words import batches_by_bytes, text_buffer, words_of

_EMPTY = np.uint64(0)

# Words are cut between kinds 1 and 2. Apostrophes and what special tokens are made of are of neither.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[list(b"!\"#$%&()*+,-./:;=?@[\\]^`{}~")] = 2

# How the tokenizer writes each byte: printable ones as themselves, the rest in order from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordEncoder:
    """Ids of texts, through an open-addressing table from word hashes to ranges of a pool of ids."""

    def __init__(self, path: str, special_as_text: bool = False, slots: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.plain = re.compile(r"(?!.*<\|)[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.slots = slots
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used, self.start, self.count, self.n = 0, np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if it has none."""
        out = np.full(len(h), -1, np.int64)
        mask, todo, slot = self.slots - 1, np.arange(len(h)), (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(todo):
            k = self.key[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (k != _EMPTY)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def _add(self, h: np.ndarray, words: list[str]) -> None:
        ids = self._encode(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        e = np.arange(self.n, self.n + len(h))
        self.start[e] = self.used + np.cumsum(n) - n
        self.count[e] = n
        self.used, self.n = self.used + len(flat), self.n + len(h)
        mask, todo, slot = self.slots - 1, np.arange(len(h)), (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(todo):
            free = np.flatnonzero(self.key[slot] == _EMPTY)
            _, first = np.unique(slot[free], return_index=True)  # one of those that want the same slot
            won = free[first]
            self.key[slot[won]] = h[todo[won]]
            self.entry[slot[won]] = e[todo[won]]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, slot = todo[on], (slot[on] + 1) & mask

    def _encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Plain Latin words are normalised and split here and go to the merges directly; others take the whole tokenizer."""
        out: list = [None] * len(words)
        rest, merges = [], self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                out[i] = [t.id for t in merges(w.lower())]
            elif not self.plain(w):
                rest.append(i)
            elif w.isascii():
                out[i] = [t.id for p in self.split(w.lower()) for t in merges(p)]
            else:
                w = unicodedata.normalize("NFC", w).lower()
                out[i] = [t.id for p in self.split(w) for t in merges("".join([_SHOWN[x] for x in p.encode()]))]
        for i, x in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def encode(self, texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids in a row, number of ids of each text) for ranges of the texts, of about `most` bytes; every text once, in order."""
        data, offsets = text_buffer(texts)
        for lo, hi in batches_by_bytes(offsets, most):
            h, s, e, n = words_of(data, offsets[lo : hi + 1], lower=False, kinds=_KINDS)
            h[h == _EMPTY] = np.uint64(1)
            at = self._find(h)
            new = np.flatnonzero(at < 0)
            if len(new):
                keys, first = np.unique(h[new], return_index=True)
                if self.n + len(keys) > self.slots // 2:
                    while self.slots // 4 < len(keys):
                        self.slots *= 2
                    self.reset()
                    new = np.arange(len(h))
                    keys, first = np.unique(h, return_index=True)
                    while self.slots // 2 < len(keys):
                        self.slots *= 2
                        self.reset()
                first = new[first]
                raw = data.tobytes() if len(data) < 1 << 20 else memoryview(data)
                self._add(keys, [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
                at[new] = self._find(h[new])
            count = self.count[at].astype(np.int64)
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.pool[np.repeat(self.start[at] - (ends - count), count) + np.arange(total)]
            words = np.concatenate([[0], np.cumsum(n)])
            edge = np.concatenate([[0], ends])[words]
            yield lo, ids, np.diff(edge)


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """This worker's encoder, kept between tasks."""
    if (key := (path, special_as_text)) not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, special_as_text)
    return _ENCODERS[key]
