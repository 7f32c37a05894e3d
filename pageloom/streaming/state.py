"""Undo and redo, one-shot downloads, progress and debounced input over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import STATE, Snapshots
from ..operators.media import percent


def undo_redo_stream(actions: DataFrame, keep: int = 50) -> DataFrame:
    """As history.undo_redo, over a stream of (page_id, seq, action, snapshot): the state of a page is its snapshots and cursor."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        history, cursor = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, 0)
        now, out = Snapshots(history, cursor, keep), []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            now.apply(r.action, r.snapshot)
            out.append((key[0], r.seq, now.cursor, len(now.history), now.history[now.cursor]))
        state.update((json.dumps(now.history), now.cursor))
        yield pd.DataFrame(out, columns=["page_id", "seq", "cursor", "depth", "snapshot"])

    return actions.groupBy("page_id").applyInPandasWithState(run, STATE, "history string, cursor int", "append", "NoTimeout")


def single_use_stream(requests: DataFrame) -> DataFrame:
    """Takes of a stream of (token, seq, kind, path) with the path served, null if none is left; taking clears the token's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        path, out = (state.get[0] if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if r.kind == "offer":
                path = r.path
            else:
                out.append((key[0], r.seq, path))
                path = None
        if path is not None:
            state.update((path,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["token", "seq", "served"])

    return requests.groupBy("token").applyInPandasWithState(run, "token string, seq long, served string", "path string", "append", "NoTimeout")


def progress_stream(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress events of a stream of pages (doc_id, page_no), joined with the documents' known totals; no state is needed."""
    out = pages.join(totals, "doc_id")
    return out.select("doc_id", F.lit("progress").alias("type"), "page_no", F.col("total_pages").alias("total"), percent(F.col("page_no"), F.col("total_pages")).alias("percent"))


def debounced(events: DataFrame, gap: str = "800 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(key, ts, value): the last of each burst of events (key, ts, value) whose gaps are shorter than `gap`, by event time."""
    kind = events.schema["ts"].dataType
    if events.isStreaming:  # watermarks need instants; a time without zone is one in the session's zone and comes back as it was
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap), "key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    return out.select("key", F.col("ts").cast(kind).alias("ts"), "value")
