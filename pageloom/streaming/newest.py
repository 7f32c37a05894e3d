"""Histories kept up to date: the newest entries of each key as a table, merged with each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.history import append_history
from ..sources import store


def merge_newest(path: str, name: str = "history", key: str | None = None, keep: int = 50) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the `keep` newest entries (id, ts, ...), of each key if one is named, as the versions of a stored table.

    A batch's version follows from its number, and it is made from the versions before it. So a batch that comes again after a
    failure changes nothing, whether or not it had been merged. What a batch reads and writes is the kept entries and its
    own rows, never the log. One stream, with one checkpoint, writes to a name.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, batch_id + 1
        if any(v >= version for v in store.versions(spark, path, name)):
            return
        before = store.read(spark, path, name, below=version)
        before = batch.limit(0) if before is None else before.drop("output_name", "version")
        store.put(append_history(before, batch, key, keep), path, name, version=version)
        store.forget(spark, path, name, keep=2)

    return merge
