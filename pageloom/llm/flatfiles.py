"""Token counts of the documents in flat token files: ids of fixed width in a row, an end id after each document, no index.

Files are cut into blocks of bytes that know nothing of documents. Each block is searched for end ids at once; what a
block needs of those before it, how many documents ended and where the last one did, is a prefix scan over the blocks'
summaries, which gives the document that runs across a boundary its whole length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, text_batches
from .tokens import encoder

_CHUNK = 1 << 10  # blocks that are scanned together


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; Spark's names of stores are put as Arrow's. Other stores than local folders, s3, gs and hdfs aren't known to it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+|^/", "file:///", uri)))


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes docs (doc_id, text) as flat files under the URI `path`, and returns (file, ordinal, doc_id), which document of which file is which row.

    Each task writes a file of its own; one that is run again writes another, and only those named in the result count.
    A null or empty text is a document without ids. A special token's string in a text is ordinary text, so no text
    holds end_id.
    """

    text_batches(docs.sparkSession)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n, out = encoder(tokenizer_path, special_as_text=True), 0, None
        kind = id_type(enc.tokenizer.get_vocab_size())
        store, folder = _at(path)
        name = f"part-{uuid.uuid4().hex}.bin"
        try:
            for b in it:
                for lo, ids, counts in enc.encode(b.column(1)):
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}")
                    out.write(np.insert(ids, np.cumsum(counts), end_id).astype(kind).tobytes())
                    some = b.column(0).slice(lo, len(counts))
                    packed = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n]), packed], names=["file", "first", "doc_ids"])
                    n += len(counts)
        finally:
            if out is not None:
                out.close()

    listed = checkpointed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "file string, first long, doc_ids array<long>"))
    return listed.select("file", "first", F.posexplode("doc_ids").alias("_i", "doc_id")).select("file", (F.col("first") + F.col("_i")).alias("ordinal"), "doc_id")


def scan_flat(files: DataFrame, end_id: int, kind: str = "<u2", block_bytes: int = 4 << 20) -> DataFrame:
    """file, ordinal (from 0), start, n_tokens, ended of every document in the files that the column `file` names, by URI.

    start counts the ids before the document in its file, n_tokens those in it without the end id. Ids after the last
    end id are a document that hasn't ended; bytes that don't make a whole id are left out. An empty file has no documents.
    """
    width = np.dtype(kind).itemsize

    def lengths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = []
            for uri in b.column(0).to_pylist():
                store, name = _at(uri)
                n.append(store.get_file_info(name).size // width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["file", "n"])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for uri, n, at in zip(*(b.column(c).to_pylist() for c in ("file", "n", "at")), strict=True):
                store, name = _at(uri)
                with store.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, (n - at) * width), at * width), kind)
                ends = np.flatnonzero(ids == end_id) + at
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n]), pa.array([at]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "n", "at", "ends"])

    step = block_bytes // width
    sized = files.select("file").distinct().mapInArrow(lengths, "file string, n long").where("n > 0")
    blocks = sized.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    found = checkpointed(blocks.repartition("file", "at").mapInArrow(search, "file string, n long, at long, ends array<long>"))
    found = found.withColumn("chunk", F.floor(F.col("at") / (step * _CHUNK)))
    # Two levels, so that one file with most of the blocks isn't one task.
    count = F.size("ends").cast("long")
    last = F.when(F.size("ends") > 0, F.col("ends")[F.size("ends") - 1])
    chunks = found.groupBy("file", "chunk").agg(F.sum(count).alias("_n"), F.max(last).alias("_e"))
    outer = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("file", "chunk", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("base"), F.coalesce(F.max("_e").over(outer), F.lit(-1)).alias("before"))
    inner = W.partitionBy("file", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.withColumn("_b", F.coalesce(F.sum(count).over(inner), F.lit(0))).withColumn("_l", F.max(last).over(inner)).join(chunks, ["file", "chunk"])
    stitched = stitched.select("file", "n", "at", "ends", (F.col("base") + F.col("_b")).alias("base"), F.coalesce("_l", "before").alias("before"))
    # The last block also has what follows the last end, if anything does.
    tail: Column = (F.col("at") + step >= F.col("n")) & (F.coalesce(last, F.col("before")) < F.col("n") - 1)
    ends = F.when(tail, F.concat("ends", F.array("n"))).otherwise(F.col("ends"))
    stitched = stitched.withColumn("ends", ends).where(F.size("ends") > 0)
    starts = F.concat(F.array(F.col("before") + 1), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x: x + 1))
    rows = stitched.withColumn("starts", starts).select("file", "base", "n", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "x"))
    return rows.select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.col("x.starts").alias("start"), (F.col("x.ends") - F.col("x.starts")).alias("n_tokens"), (F.col("x.ends") < F.col("n")).alias("ended"))


def token_counts(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, kind: str = "<u2") -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in the flat files that are written under `path`."""
    rows = write_flat(docs, path, tokenizer_path, end_id)
    found = scan_flat(rows.select("file"), end_id, kind)
    return rows.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
