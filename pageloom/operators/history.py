"""Logs of what was done, and what stays in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import concat


def append_history(log: DataFrame, new: DataFrame, key: str | None = None, keep: int = 50) -> DataFrame:
    """The `keep` newest entries (id, ts, ...) of the log with the new ones, of each key if one is named; ties by id."""
    both = log.unionByName(new)
    order = [F.col("ts").desc(), F.col("id").desc()]
    if key is None:
        return both.orderBy(*order).limit(keep)
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def entry_id(*parts: Column) -> Column:
    """Eight characters made of what an entry says, so that reruns agree."""
    return F.substring(F.sha2(concat(*[p.cast("string") for p in parts]), 256), 1, 8)


def memory_sizes(files: DataFrame, key: str) -> DataFrame:
    """(key, bytes, files): a file's size is its own or that of the file inside it, else 0."""
    return files.groupBy(key).agg(F.sum(F.coalesce("size", "inner_size", F.lit(0))).alias("bytes"), F.count("*").alias("files"))


EVICTED = "key long, at_seq long, entry long, size long, held_bytes long, held_entries int"


def eviction(entries: DataFrame, limit: int = 100 << 20) -> DataFrame:
    """(key, at_seq, entry, size, held_bytes, held_entries) after each of entries (key, seq, entry, size), in the order of seq.

    A new entry joins those held, unless it alone is over the limit: then it is all that is held. No loop over
    history is needed: what is held are the entries since the last large one.
    """
    w = W.partitionBy("key").orderBy("seq")
    x = entries.withColumn("_reset", F.sum((F.col("size") > limit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = W.partitionBy("key", "_reset").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return x.select("key", F.col("seq").alias("at_seq"), "entry", "size", F.sum("size").over(held).alias("held_bytes"), F.count("*").over(held).cast("int").alias("held_entries"))


STATE = "page_id long, seq long, cursor int, depth int, snapshot string"


class Snapshots:
    """A page's snapshots and the cursor among them: at most `keep`, a commit drops what was undone."""

    def __init__(self, history: list[str] | None = None, cursor: int = 0, keep: int = 50):
        self.history, self.cursor, self.keep = history or ["[]"], cursor, keep

    def apply(self, action: str, snapshot: str | None) -> None:
        if action == "undo":
            self.cursor = max(0, self.cursor - 1)
        elif action == "redo":
            self.cursor = min(len(self.history) - 1, self.cursor + 1)
        elif action == "delete" or (action == "commit" and self.history[self.cursor] != snapshot):
            self.history = [*self.history[: self.cursor + 1], snapshot][-self.keep :]
            self.cursor = len(self.history) - 1


def undo_redo(actions: DataFrame, keep: int = 50) -> DataFrame:
    """(page_id, seq, cursor, depth, snapshot) after each of actions (page_id, seq, action, snapshot).

    commit takes a snapshot unless it equals the current one, delete takes it always; undo and redo move the cursor. A
    fold over each page's actions in order: pages are sorted in their partitions and passed along, none is gathered.
    """

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, now = None, Snapshots(keep=keep)
        for pdf in it:
            out = []
            for p, seq, action, snapshot in pdf.itertuples(index=False):
                if p != page:
                    page, now = p, Snapshots(keep=keep)
                now.apply(action, snapshot)
                out.append((p, seq, now.cursor, len(now.history), now.history[now.cursor]))
            yield pd.DataFrame(out, columns=["page_id", "seq", "cursor", "depth", "snapshot"])

    rows = actions.where("page_id is not null").select("page_id", "seq", "action", "snapshot")
    return rows.repartition("page_id").sortWithinPartitions("page_id", "seq").mapInPandas(fold, STATE)


def single_use(downloads: DataFrame) -> DataFrame:
    """Requests (token, seq, kind: offer or take, path) with `served`: the path that a take gets; each offer serves the first take after it."""
    w = W.partitionBy("token").orderBy("seq")
    before = F.lag(F.struct("kind", "path")).over(w)
    return downloads.withColumn("served", F.when((F.col("kind") == "take") & (before["kind"] == "offer"), before["path"]))
