"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER bytes long with the counts of the bytes that followed.
The statistics are frozen after training, so the code length of a byte depends on its context alone: a context passes on
to the one that is a byte shorter with an escape probability (method C: as likely as there are distinct bytes),
and a byte that was seen in the context has its share of the counts besides; below them all, bytes are
equally likely. A context that a language never saw passes everything on. The trees of all languages are laid out as sorted
entries by code and language, one table an order: the code lengths of what a language saw there, and what an escape costs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import free_name, in_text_batches, text_batches
from .words import batches_by_bytes, text_buffer

ORDER = 3
WINDOW = 128  # bytes
_PIECE = 1 << 21  # code lengths that are held at once
_COUNTED = 1 << 20  # bytes of a text whose contexts are counted at once
_DEALT = 8


def windows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, owner): where the stretches of `width` bytes of all texts begin, with the end of the last, and the text of each stretch."""
    size = np.diff(offsets)
    n = -(-size // width)
    owner = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.append(offsets[:-1][owner] + place * width, offsets[-1]), owner


def _mask(k: int) -> np.uint32:
    return np.uint32((1 << 8 * (k + 1)) - 1)


def codes(data: np.ndarray, edges: np.ndarray, at: int, to: int) -> np.ndarray:
    """Each byte of data[at:to] with the ORDER bytes before it in front; blanks precede the texts, which begin at edges."""
    size, lead = to - at, min(ORDER, at)
    s = np.concatenate([np.zeros(ORDER - lead, np.uint8), data[at - lead : to]]).astype(np.uint32)
    out = np.zeros(size, np.uint32)
    for j in range(ORDER + 1):
        out = (out << np.uint32(8)) | s[j : j + size]
    lo, hi = np.searchsorted(edges, [at - ORDER, to])
    for d in range(ORDER):
        x = edges[lo:hi] - at + d
        x = x[(x >= 0) & (x < size)]
        out[x] = (out[x] & _mask(d)) | (np.uint32(0x20202020) & ~_mask(d))
    return out


class Entries:
    """Bits by (code, language), for the languages that have any: sorted codes, and where each one's languages begin."""

    def __init__(self, code: np.ndarray, language: np.ndarray, p: np.ndarray):
        self.code, start = np.unique(code.astype(np.uint32), return_index=True)
        self.start = np.append(start, len(code))
        self.language, self.bits = language.astype(np.int32), (-np.log2(p)).astype(np.float32)

    def find(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into some, language, bits) of all entries of the codes."""
        at = np.minimum(np.searchsorted(self.code, some), len(self.code) - 1)
        hit = np.flatnonzero(self.code[at] == some)
        first = self.start[at[hit]]
        n = self.start[at[hit] + 1] - first
        entry = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return np.repeat(hit, n), self.language[entry], self.bits[entry]


class Contexts:
    """The frozen trees of all languages, from how often each language has each code: a byte with the ORDER bytes before it.

    For each order k, what a language saw has entries: codes of k + 1 bytes with their bits, contexts of k bytes with the
    bits of an escape. So the size is that of the trees together, however many languages there are. `nothing` has each byte's bits
    without any context or language.
    """

    def __init__(self, languages: list[str], language: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.languages = languages
        self.seen, self.escapes = [], []
        if not languages:
            return
        many, before, p = np.uint64(len(languages)), None, None
        for k in range(ORDER + 1):
            key, at = np.unique((code & _mask(k)).astype(np.uint64) * many + language.astype(np.uint64), return_inverse=True)
            c, j, m = key // many, key % many, np.bincount(at, n)
            context, own = np.unique((c >> np.uint64(8)) * many + j, return_inverse=True)
            total, kinds = np.bincount(own, m), np.bincount(own)
            escape = kinds / (total + kinds)
            lower = p[np.searchsorted(before, (c & np.uint64(_mask(k - 1))) * many + j)] if k else 1 / 256
            before, p = key, m / (total + kinds)[own] + escape[own] * lower
            self.seen.append(Entries(c, j, p))
            self.escapes.append(Entries(context // many, context % many, escape))
        of = np.bincount(code & _mask(0), n, 256)
        kinds = np.count_nonzero(of)
        self.nothing = (-np.log2((of + kinds / 256) / (of.sum() + kinds))).astype(np.float32)

    def _cost(self, code: np.ndarray) -> np.ndarray:
        """Bits of each code's last byte in every language."""
        many = len(self.languages)
        out = np.full(len(code) * many, 8, np.float32)
        for k in range(ORDER + 1):
            some = code & _mask(k)
            row, language, bits = self.escapes[k].find(some >> np.uint32(8))
            out[row * many + language] += bits
            row, language, bits = self.seen[k].find(some)
            out[row * many + language] = bits
        return out.reshape(len(code), many)

    def lengths(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each stretch of the texts takes in each language, (stretch, language), and with `nothing`. offsets: of texts; cuts: of stretches, each within a text.

        A stretch's contexts go back into the one before it, but not into another text.
        """
        out, plain = np.zeros((len(cuts) - 1, len(self.languages))), np.zeros(len(cuts) - 1)
        at, stop, step = int(offsets[0]), int(offsets[-1]), max(1 << 12, _PIECE // len(self.languages))
        while at < stop:
            to = min(at + step, stop)
            code, place = np.unique(codes(data, offsets[:-1], at, to), return_inverse=True)
            cost = self._cost(code)[place]
            first, last = np.searchsorted(cuts, [at + 1, to])
            starts = np.concatenate([[0], cuts[first:last] - at])
            owner = np.searchsorted(cuts, starts + at, "right") - 1
            keep = np.diff(np.append(starts, to - at)) > 0
            starts, owner = starts[keep], owner[keep]
            np.add.at(out, owner, np.add.reduceat(cost, starts, axis=0, dtype=np.float64))
            np.add.at(plain, owner, np.add.reduceat(self.nothing[data[at:to]], starts, dtype=np.float64))
            at = to
        return out, plain


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, code, n) of rows (language, text), each piece of texts counted on its own."""
    for b in it:
        data, offsets = text_buffer(b.column("text"))
        language = b.column("language").to_numpy().astype(np.uint64)
        for lo, hi in batches_by_bytes(offsets, _COUNTED):
            at, stop = int(offsets[lo]), int(offsets[hi])
            while at < stop:
                to = min(at + _COUNTED, stop)
                owner = np.searchsorted(offsets, np.arange(at, to), "right") - 1
                key, n = np.unique(language[owner] << np.uint64(32) | codes(data, offsets[:-1], at, to), return_counts=True)
                code = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["language", "code", "n"])
                at = to


def train(docs: DataFrame, docs_per_language: int = 300) -> Contexts:
    """Trees of every non-null lang of docs (doc_id, text, lang): from docs_per_language whole documents each, chosen by hashes among all; from all that it has, if it has no more.

    This number bounds the training sample. Its contexts are counted in tasks and only the counts, a row for each
    language and code that it has, reach the driver. Rows equal in doc_id and text are one; null and empty texts are left out; no rows, no languages.
    """
    rows = docs.where("lang is not null and text is not null and text != ''").select("lang", "text", F.xxhash64("doc_id", "text").alias("_k"))
    # Rows are chosen without their texts. A language's least hashes are among the least of each of its shares, so no task gets more than a few shares' worth.
    narrow = rows.select("lang", "_k").distinct()
    for by in (["lang", F.pmod("_k", F.lit(_DEALT))], ["lang"]):
        narrow = narrow.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_k"))).where(F.col("_r") <= docs_per_language).drop("_r")
    chosen = [(r["lang"], r["_k"]) for r in narrow.collect()]  # docs_per_language for each language
    languages = sorted({x for x, _ in chosen})
    if not languages:
        return Contexts([], *(np.zeros(0, np.int64),) * 3)
    spark, number = docs.sparkSession, {x: i for i, x in enumerate(languages)}
    chosen = F.broadcast(spark.createDataFrame([(x, k, number[x]) for x, k in chosen], "lang string, _k long, language int"))
    few = rows.join(chosen, ["lang", "_k"]).dropDuplicates(["language", "_k"]).select("language", "text")
    with in_text_batches(spark):
        counts = few.mapInArrow(_counted, "language int, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n")).toArrow()
    return Contexts(languages, *(counts.column(x).to_numpy().astype(t) for x, t in (("language", np.int64), ("code", np.uint32), ("n", np.int64))))


def predict(docs: DataFrame, model: Contexts) -> DataFrame:
    """docs with lang_pred, score and gain added, from the whole text; columns of these names are replaced, others stay.

    Each stretch of WINDOW bytes gives every language its probability, all being equally likely beforehand, and lang_pred
    is the language with the largest part of the text; score is that part. So a passage in another language counts by its
    length, not by the bits that it costs. gain is how many bits shorter the text is with the languages, each stretch in any of them,
    than as bytes without context: the more below 0, the less it looks like any of them. A null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned, and gain is 0 then.
    Texts don't see each other, so repeated rows give repeated results; of languages with equal parts the first by name is told.
    """
    if not model.languages:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0)).withColumn("gain", F.lit(0.0))
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "gain")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("gain", T.DoubleType())])
    has_letter = free_name(names, "_letter")
    docs = docs.withColumn(has_letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = np.array(m.languages, object)
        for b in it:
            data, offsets = text_buffer(b.column("text"))
            share, gain = np.zeros((b.num_rows, len(known))), np.zeros(b.num_rows)
            for lo, hi in batches_by_bytes(offsets):
                some = offsets[lo : hi + 1]
                cuts, owner = windows(some, WINDOW)
                bits, plain = m.lengths(data, some, cuts)
                least = bits.min(1)
                chance = np.exp2(least[:, None] - bits)
                total = chance.sum(1)
                np.add.at(gain, owner + lo, plain - least + np.log2(total / len(known)))
                chance *= (np.diff(cuts) / total)[:, None]
                np.add.at(share, owner + lo, chance)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            best = share.argmax(1)
            letter = b.column(has_letter).to_numpy(zero_copy_only=False)
            lang = np.where(letter, known[best], "und")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(np.where(letter, share.max(1), 0.0)), pa.array(gain)], names=[*names, "lang_pred", "score", "gain"])

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the decimal doc_id leaves another remainder than 1 by 3."""
    return docs.where(~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
