"""Stupid-backoff trigram scores of all documents under counts of all documents, as joins of count tables with exploded n-grams.

Tokens are 16-bit ids of a public vocabulary, so a trigram is one 48-bit code. Every token ends one trigram, the first ones
after two starts of text. The trigrams of the corpus, counted per task first, make a count table partitioned by hash of
their first two tokens, so that the counts of that context are there too. The distinct trigrams of each document are
exploded into the same partitions, joined with the counts there and summed per document. Rows travel in blocks, a trigram once
with the documents that have it. A partition is dealt into `salts` where even one trigram of every document
would be too much for a task; the count table's part goes to each.
Trigrams without evidence go on as rows, which Spark joins with the bigram counts and, at last, the unigram counts.

The corpus that is counted is the one that is scored, where no trigram would ever be unknown. So a document is no evidence
for itself: with C the counts of all other documents, c after a b scores C(abc) / C(ab), or if that is 0, alpha * C(bc) / C(b),
or if that is 0, alpha^2 * C(c) / N.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, merged_slices, text_batches, zipped
from .tokens import encoder

ALPHA = 0.4
_FLUSH = 1 << 19  # tokens that a task gathers before it takes them on
_BYTES = 2 << 20  # of texts that are encoded at once
_DOCS = 1 << 15  # documents that it gathers
_KNOWN = 2 << 20  # trigrams that a task counts before it hands them over
_PART = 6 << 20  # trigrams of documents in a partition, about
_ONE = 1 << 20  # scores are summed as whole multiples of 1 / _ONE, so the order of the sum doesn't matter


def row_key(docs: DataFrame):
    """Rows equal in doc_id and text are one document."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _put(x: np.ndarray) -> bytes:
    """Numbers from 0 on, all in as few bytes as the largest needs, first bytes before second ones, compressed."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return zstandard.compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _got(data: pa.Scalar, n: int) -> np.ndarray:
    """The n numbers that _put was given."""
    raw = np.frombuffer(zstandard.decompress(data.as_buffer()), np.uint8)
    width = max(1, len(raw) // max(n, 1))
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(sorted_[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _flushes(it: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, runs, codes): the documents' keys and numbers of tokens, and the trigram a b c that ends at each token as a << 32 | b << 16 | c; the size of the vocabulary is the start of a text."""
    enc = encoder(tokenizer_path, special_as_text=True)
    start = np.uint64(enc.tokenizer.get_vocab_size())
    held: list[tuple] = []
    size = docs = 0
    for batch in it:
        keys = batch.column(0).to_numpy()
        for lo, ids, counts in enc.encode(batch.column(1), _BYTES):
            some = counts > 0
            first = (np.cumsum(counts) - counts)[some]
            c = ids.astype(np.uint64)
            b, a = np.full(len(c), start), np.full(len(c), start)
            b[1:] = c[:-1]
            b[first] = start
            a[1:] = b[:-1]
            a[first] = start
            held.append((keys[lo : lo + len(counts)][some], counts[some], a << np.uint64(32) | b << np.uint64(16) | c))
            size, docs = size + len(c), docs + len(first)
            del a, b, c
            if size > _FLUSH or docs > _DOCS:
                full = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size, docs = [], 0, 0
                yield full
                del full
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _part_of(codes: np.ndarray, bits: int) -> np.ndarray:
    """The hash partition of trigrams, by their first two tokens."""
    return (((codes >> np.uint64(16)).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def _by_place(place: np.ndarray) -> np.ndarray:
    """The stable order of small numbers from 0 on; numpy sorts 16-bit ones by radix."""
    return np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = _starts(codes)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


COUNTS = "part int, n int, codes binary, counts binary"


def _counts_batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of part, sorted codes and their counts."""
    cols = ([r[0] for r in rows], [len(r[1]) for r in rows], [_put(np.diff(r[1], prepend=np.uint64(0))) for r in rows], [_put(r[2]) for r in rows])
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("part", "n", "codes", "counts"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def _counts_of(codes: pa.Scalar, counts: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_got(codes, n)).astype(np.uint64), _got(counts, n)


def count_table(texts: DataFrame, tokenizer_path: str, bits: int) -> DataFrame:
    """(part, n, codes, counts) of all trigrams of texts (key, text), a row per hash partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            part = _part_of(codes, bits)
            order = _by_place(part)
            cut = _starts(part[order])
            c, n = np.split(codes[order], cut[1:]), np.split(counts[order], cut[1:])
            yield from _counts_batch(list(zip(part[order][cut].tolist(), c, n, strict=True))).to_batches()

        for _, _, new in _flushes(it, tokenizer_path):
            new = np.sort(new)
            first = _starts(new)
            codes, counts = _summed(np.concatenate([codes, new[first]]), np.concatenate([counts, _sizes(first, len(new))]))
            if len(codes) > _KNOWN:
                yield from out()
                codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield from out()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        rows = [_counts_of(t.column("codes")[i], t.column("counts")[i], t.column("n")[i].as_py()) for i in range(t.num_rows)]
        return _counts_batch([(key[0].as_py(), *_summed(*(np.concatenate(x) for x in zip(*rows, strict=True))))])

    return texts.mapInArrow(run, COUNTS).groupBy("part").applyInArrow(merge, COUNTS)


def _tables(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in it:
        for i in range(b.num_rows):
            yield _counts_of(b.column("codes")[i], b.column("counts")[i], b.column("n")[i].as_py())


def unigrams(table: DataFrame, base: int) -> pd.DataFrame:
    """(token, n, followed): how often each token occurs, and how often one follows it; a row per token, the start of a text last."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(2 * base, np.int64)
        for codes, counts in _tables(it):
            for k, shift in enumerate((0, 16)):
                token = (codes >> np.uint64(shift)).astype(np.int64) & 0xFFFF
                total[k * base : (k + 1) * base] += np.bincount(token, counts, base).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "slice": pa.array([0], pa.int32()), "data": pa.array([zipped(total)], pa.binary())})

    total = merged_slices(checkpointed(table.mapInArrow(run, "part long, slice int, data binary")), "add", "<i8").get(0, np.zeros(2 * base, np.int64))
    return pd.DataFrame({"token": np.arange(base), "n": total[:base], "followed": total[base:]})


def bigrams(table: DataFrame) -> DataFrame:
    """(code, n): the bigrams that end the trigrams of the count table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in _tables(it):
            code, n = _summed(codes & np.uint64(0xFFFFFFFF), counts)
            for at in range(0, len(code), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + (1 << 17)].view(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["code", "n"])

    return table.select("n", "codes", "counts").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


OWN = ("own_bigram", "own_context", "own_token")


def exploded(texts: DataFrame, tokenizer_path: str, bits: int, salts: int) -> DataFrame:
    """The distinct trigrams of each document, in blocks by hash partition and, within it, by hash of the document.

    A block lists its documents' keys and n trigrams; for each trigram, how many documents have it; for each of these, which and how
    often (m). A trigram that no other document of the block has may need to back off, so it comes with how often its document has its
    last two tokens, the former of them followed by any, and its last token.
    """
    columns = ("keys", "codes", "docs", "which", "m", *OWN)

    low, tail = np.uint64(16), np.uint64(0xFFFFFFFF)

    def own_counts(doc: np.ndarray, codes: np.ndarray, asked: np.ndarray) -> list[np.ndarray]:
        """OWN for each of the bigrams asked for, doc << 32 | b << 16 | c."""
        by = np.argsort(asked)  # lookups in order touch memory in order
        asked = asked[by]
        last = np.sort(doc << np.uint64(32) | codes & tail)
        first = _starts(last)
        two, n = last[first], _sizes(first, len(last))
        context = _starts(two >> low)
        token = np.sort(doc << low | codes & np.uint64(0xFFFF))
        first = _starts(token)
        of = [(two, n, asked), (two[context] >> low, np.add.reduceat(n, context), asked >> low)]
        of.append((token[first], _sizes(first, len(token)), asked >> np.uint64(32) << low | asked & np.uint64(0xFFFF)))
        out = [np.empty(len(by), np.int32) for _ in of]
        for x, (known, n, key) in zip(out, of, strict=True):
            x[by] = n[np.searchsorted(known, key)]
        return out

    def postings(keys: np.ndarray, doc: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, code << 16 | doc, m), ordered by place, code and document."""
        pair = np.sort(codes << low | doc)  # documents are fewer than 2 ** 16
        first = _starts(pair)
        m = _sizes(first, len(pair)).astype(np.int32)
        pair = pair[first]
        place = _part_of(pair >> low, bits) * salts + keys[(pair & np.uint64(0xFFFF)).astype(np.int64)] % salts
        order = _by_place(place)
        return place[order], pair[order], m[order]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, runs, codes in _flushes(it, tokenizer_path):
            doc = np.repeat(np.arange(len(keys), dtype=np.uint64), runs)
            place, pair, m = postings(keys, doc, codes)
            code = pair >> low
            each = _starts(place, code)
            docs = _sizes(each, len(code)).astype(np.int32)
            alone = each[docs == 1]
            own = own_counts(doc, codes, (pair[alone] & np.uint64(0xFFFF)) << np.uint64(32) | code[alone] & tail)
            del codes
            doc = (pair & np.uint64(0xFFFF)).astype(np.int32)
            del pair
            cut = np.append(_starts(place), len(place))
            each_cut, alone_cut = np.searchsorted(each, cut), np.searchsorted(alone, cut)
            code = code[each]
            for k, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                e, s = slice(each_cut[k], each_cut[k + 1]), slice(alone_cut[k], alone_cut[k + 1])
                there, which = np.unique(doc[a:z], return_inverse=True)
                data = [keys[there].tobytes(), _put(np.diff(code[e], prepend=np.uint64(0))), _put(docs[e]), _put(which), _put(m[a:z]), *[_put(x[s]) for x in own]]
                ints = (*divmod(int(place[a]), salts), each_cut[k + 1] - each_cut[k])
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in ints], *[pa.array([x], pa.binary()) for x in data]], names=["part", "salt", "n", *columns])

    return texts.mapInArrow(run, "part int, salt int, n int, " + ", ".join(f"{c} binary" for c in columns))


SUMS = ("tokens", "cost", "copies")
UNSEEN = ("code", "m", *OWN)
JOINED = "bucket int, n int, keys binary, data array<binary>"


def _joined(rows: list[tuple[int, np.ndarray, list[np.ndarray]]]) -> pa.Table:
    cols = ([r[0] for r in rows], [len(r[1]) for r in rows], [r[1].tobytes() for r in rows], [[_put(x) for x in r[2]] for r in rows])
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("bucket", "n", "keys", "data"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())), strict=True)})


def _scored(left: pa.Table, right: pa.Table, bits: int, start: int, leave_out: bool) -> pa.Table:
    """Sums of each document over a partition's trigrams, in blocks by hash of the document, and in blocks of bucket -1 the trigrams that no other document has."""
    codes, counts = _counts_of(right.column("codes")[0], right.column("counts")[0], right.column("n")[0].as_py())
    first = _starts(codes >> np.uint64(16))
    contexts, followed = codes[first] >> np.uint64(16), np.add.reduceat(counts, first)
    empty = start << 16 | start
    every, sums, unseen = [], [], []
    for i in range(left.num_rows):
        row = {c: left.column(c)[i] for c in left.column_names}
        n, keys = row["n"].as_py(), np.frombuffer(row["keys"].as_buffer(), "<i8")
        code, docs = np.cumsum(_got(row["codes"], n)).astype(np.uint64), _got(row["docs"], n)
        which, m = (_got(row[c], int(docs.sum())) for c in ("which", "m"))
        context = code >> np.uint64(16)
        rest = np.repeat(counts[np.searchsorted(codes, code)], docs)
        among = np.repeat(followed[np.searchsorted(contexts, context)], docs)
        if leave_out:
            pair = np.repeat(np.cumsum(np.diff(context, prepend=context[:1]) != 0), docs) * len(keys) + which
            _, pair = np.unique(pair, return_inverse=True)
            rest, among = rest - m, among - np.bincount(pair, m).astype(np.int64)[pair]
        seen = rest > 0
        cost = np.zeros(len(m))
        cost[seen] = np.rint(np.log2(among[seen] / rest[seen]) * _ONE) * m[seen]
        begins = np.repeat(context == empty, docs)
        every.append(keys)
        sums.append([np.bincount(which, x, len(keys)).astype(np.int64) for x in (m, cost, begins)])
        if not seen.all():
            gone = np.flatnonzero(~seen)
            of = np.repeat(np.arange(n), docs)[gone]
            alone = (np.cumsum(docs == 1) - 1)[of]
            some = int((docs == 1).sum())
            unseen.append((keys[which[gone]], (code[of] & np.uint64(0xFFFFFFFF)).astype(np.int64), m[gone], *[_got(row[c], some)[alone] for c in OWN]))
    keys, at = np.unique(np.concatenate(every), return_inverse=True)
    sums = [np.bincount(at, np.concatenate(x), len(keys)).astype(np.int64) for x in zip(*sums, strict=True)]
    bucket = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)  # no more blocks than there are partitions
    order = np.argsort(bucket, kind="stable")
    cut = np.append(_starts(bucket[order]), len(order)).tolist()
    rows = [(int(bucket[order[a]]), keys[order[a:z]], [x[order[a:z]] for x in sums]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    if unseen:
        keys, *data = (np.concatenate(x) for x in zip(*unseen, strict=True))
        rows += [(-1, keys[at : at + (1 << 16)], [x[at : at + (1 << 16)] for x in data]) for at in range(0, len(keys), 1 << 16)]
    return _joined(rows)


def _totals(key: tuple, t: pa.Table) -> pa.Table:
    """The sums of each document in a bucket, from all partitions."""
    keys, sums = [], []
    for i in range(t.num_rows):
        n = t.column("n")[i].as_py()
        keys.append(np.frombuffer(t.column("keys")[i].as_buffer(), "<i8"))
        sums.append([_got(x, n) for x in t.column("data")[i]])
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    return pa.table({"key": own} | {c: np.bincount(at, np.concatenate(x), len(own)).astype(np.int64) for c, x in zip(SUMS, zip(*sums, strict=True), strict=True)})


def _unseen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i in range(b.num_rows):
            n = b.column("n")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.column("keys")[i].as_buffer(), "<i8")), *[pa.array(_got(x, n)) for x in b.column("data")[i]]], names=["key", *UNSEEN])


def stupid_backoff(docs: DataFrame, tokenizer_path: str, alpha: float = ALPHA, part: int = _PART, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, score, log2_sum of every row of docs (doc_id, text; other columns are ignored).

    log2_sum is the sum of the logarithms of the scores of all tokens of the whole text, the first one after two starts of
    text; score is its mean, which compares texts of different lengths. A token that no count is left for counts a half. A null or empty text
    has no tokens, log2_sum 0 and null score. Rows equal in doc_id and text are one document that occurs more than once:
    each gets the same score, and the others are evidence for it. leave_out=False keeps a document's own occurrences in
    the counts, so that nothing backs off. part: trigrams of documents that a task joins at once, about.
    The vocabulary must have fewer than 2 ** 16 tokens.
    """
    spark = docs.sparkSession
    start = encoder(tokenizer_path, special_as_text=True).tokenizer.get_vocab_size()
    if start >= 1 << 16:
        raise ValueError("tokens of this vocabulary don't fit 16 bits")
    text_batches(spark)
    docs = docs.select("doc_id", "text")
    texts = docs.select(row_key(docs).alias("key"), "text")
    rows, octets = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    bits = min(22, max(2, math.ceil(math.log2(max(1, (octets or 0) / 3 / part)))))
    salts = -(-max(rows, 1) // part)
    table = checkpointed(count_table(texts, tokenizer_path, bits))
    single = unigrams(table, start + 1)
    total = int(single["n"].sum())
    single = F.broadcast(spark.createDataFrame(single, "token long, n long, followed long"))  # a row per token, whatever the corpus

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right, bits, start, leave_out) if left.num_rows else _joined([])  # no document of this salt has one of these trigrams

    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = checkpointed(exploded(texts, tokenizer_path, bits, salts).groupBy("part", "salt").cogroup(salted.groupBy("part", "salt")).applyInArrow(join, JOINED))
    sums = parts.where("bucket >= 0").groupBy("bucket").applyInArrow(_totals, "key long, " + ", ".join(f"{c} long" for c in SUMS))

    back = parts.where("bucket < 0").select("n", "keys", "data").mapInArrow(_unseen, "key long, " + ", ".join(f"{c} long" for c in UNSEEN))
    back = back.join(bigrams(table), "code").select("*", F.shiftright("code", 16).alias("b"), F.col("code").bitwiseAND(0xFFFF).alias("c"), (F.col("n") - F.col("own_bigram")).alias("rest"))
    back = back.join(single.select(F.col("token").alias("b"), "followed"), "b").join(single.select(F.col("token").alias("c"), F.col("n").alias("n_token")), "c")
    known = F.col("rest") > 0
    cost = F.when(known, F.log2((F.col("followed") - F.col("own_context")) / F.col("rest"))).otherwise(-F.log2(F.lit(alpha)) - F.log2(F.greatest(F.col("n_token") - F.col("own_token"), F.lit(0.5)))) - F.log2(F.lit(alpha))
    more = back.groupBy("key").agg(F.sum(F.rint(cost * _ONE).cast("long") * F.col("m")).alias("more"), F.sum(F.when(known, 0).otherwise(F.col("m"))).alias("backoffs"))

    each = sums.join(more, "key", "left").fillna(0, ["more", "backoffs"])
    each = each.select("key", *[F.expr(f"{c} div copies").alias(c) for c in ("tokens", "backoffs")], (-(F.col("cost") + F.col("more")) / F.col("copies") / _ONE).alias("known"))
    out = docs.select("doc_id", row_key(docs).alias("key")).join(each, "key", "left")
    n = F.coalesce("tokens", F.lit(0))
    log2 = F.coalesce(F.col("known") - F.col("backoffs") * F.log2(F.greatest(F.lit(total) - F.col("tokens"), F.lit(1)).cast("double")), F.lit(0.0))
    return out.select("doc_id", n.alias("n_tokens"), F.when(n > 0, log2 / n).alias("score"), log2.alias("log2_sum"))
