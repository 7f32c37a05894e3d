"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

Every batch of documents becomes a run: its distinct line keys, as 128-bit hashes, each with the number of
rows that hold it and the first of them, sorted by hash. Keys that the runs have settled by then, being in enough
documents, are taken out of the batch by a merge anti join. A level that has `fanout` runs is merged
into one run of the next level, so each key is rewritten a number of times logarithmic in the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, delete_shared, free_name, shared_dir

_BLANKS = " \t\n\x0b\f\r"
_HOT, _SALTS = 10_000, 64  # a key with a ten-thousandth of all hits is dealt over so many tasks
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The text split at newlines; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def key_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def key_hashes(text: Column) -> Column:
    """The hashes of the text's distinct keys that aren't empty."""
    return F.transform(F.array_remove(F.array_distinct(F.transform(lines_of(text), line_key)), ""), key_hash)


def row_of(docs: DataFrame) -> Column:
    """What tells a row apart; rows equal in doc_id and text are the same."""
    return F.struct(docs["doc_id"].isNull().alias("missing"), docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["doc_id"], docs["text"]).alias("hash"))


class LineRuns:
    """Sorted runs of (h1, h2, docs, first) in the shared folder: docs rows hold the key, and first is the one of least doc_id, then of least hash."""

    SCHEMA = "h1 long, h2 long, docs long, first struct<missing: boolean, doc: long, hash: long>"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.path = path or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"

    def _write(self, run: DataFrame, level: int) -> None:
        to = f"{self.path}/level={level}/{uuid.uuid4().hex}"
        run.sortWithinPartitions("h1", "h2").write.parquet(to)
        self.levels.setdefault(level, []).append(to)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            self._write(self._merged(old), level + 1)
            for p in old:
                delete_shared(self.spark, p)

    def _merged(self, paths: list[str]) -> DataFrame:
        runs = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        return runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))

    def add(self, docs: DataFrame, min_docs: int | None = None) -> None:
        """Adds the lines of a batch (doc_id, text) as a run. Every row counts as a document.

        With min_docs, keys that the runs before hold in so many documents are settled: the batch is merge-anti-joined
        with them, and only what they leave becomes a run.
        """
        rows = docs.select(row_of(docs).alias("first"), F.explode(key_hashes(F.col("text"))).alias("h"))
        run = rows.groupBy("h.h1", "h.h2").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
        if min_docs and self.levels:
            run = run.hint("merge").join(self.heavy(min_docs).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._write(run, 0)

    def keys(self) -> DataFrame:
        """All runs together, one row per key."""
        paths = [p for level in self.levels.values() for p in level]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self._merged(paths)

    def delete(self) -> None:
        delete_shared(self.spark, self.path)
        self.levels = {}

    def heavy(self, min_docs: int) -> DataFrame:
        return self.keys().where(F.col("docs") >= min_docs)

    def unseen(self, docs: DataFrame) -> DataFrame:
        """The lines (doc_id, line_no, line, h1, h2) of a batch whose key is in no run yet; blank lines are left out."""
        rows = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")).withColumn("h", key_hash(line_key(F.col("line")))).where(line_key(F.col("line")) != "")
        rows = rows.select("doc_id", "line_no", "line", "h.h1", "h.h2")
        return rows.hint("merge").join(self.keys().select("h1", "h2"), ["h1", "h2"], "left_anti")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, batches: int = 3, fanout: int = 2) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added: lines whose key is in at least min_docs rows of docs are dropped.

    keep_first: one row that holds the key keeps it, the one with the least doc_id, then the least hash, in the batches until it was
    settled; a null doc_id comes last, and rows equal in doc_id and text are one, so each of them keeps it.
    A null or empty text is one empty line, which stays. Every row counts as a document, also if doc_ids repeat or are null. Other columns stay.
    The table is added to the runs in `batches` parts; then each document's keys are joined with the heavy ones. A key with
    many of all hits is dealt over several tasks; there are no more than _HOT of them, which is what is broadcast.
    """
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    for i in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(batches)) == i) if batches > 1 else docs, min_docs)
    heavy = checkpointed(runs.heavy(min_docs))
    runs.delete()
    hits = heavy.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") * _HOT >= F.lit(hits)
    salts = heavy.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    rows = docs.select(row_of(docs).alias("_row"), F.explode(key_hashes(F.col("text"))).alias("h")).select("_row", "h.h1", "h.h2")
    rows = rows.join(F.broadcast(heavy.where(hot).select("h1", "h2", F.lit(True).alias("hot"))), ["h1", "h2"], "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("_row.hash"), F.lit(_SALTS)).cast("int")).otherwise(0))
    hit = rows.join(salts, ["h1", "h2", "salt"])
    if keep_first:
        hit = hit.where(F.col("_row") != F.col("first"))
    of_row, its_heavy, remain = (free_name(docs.columns, c) for c in ("_hit", "_heavy", "_kept"))
    per_row = hit.groupBy(F.col("_row.hash").alias(of_row)).agg(F.collect_set(F.struct("h1", "h2")).alias(its_heavy))
    out = docs.join(per_row, row_of(docs)["hash"] == F.col(of_row), "left").drop(of_row)
    lines = lines_of(F.col("text"))
    kept = F.when(F.col(its_heavy).isNull(), lines).otherwise(F.filter(lines, lambda x: (line_key(x) == "") | ~F.array_contains(F.col(its_heavy), key_hash(line_key(x)))))
    out = out.withColumn(remain, kept)
    return out.withColumns({"kept_text": F.array_join(remain, "\n"), "n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(remain)).cast("long")}).drop(its_heavy, remain)
