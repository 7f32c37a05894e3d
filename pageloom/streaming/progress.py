"""Progress of requests as finite streams: progress events, then exactly one that it is complete or failed, and none after it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "request long, type string, page int, total int, percent double, message string, ts timestamp"
EPOCH = datetime(1970, 1, 1)


def _micros(ts: datetime) -> int:
    """Since 1970, of an instant as Python rows have it: local time, or with its zone."""
    return int(ts.timestamp() * 1_000_000)


def _instant(micros: int) -> datetime:
    return (EPOCH.replace(tzinfo=timezone.utc) + timedelta(microseconds=micros)).astimezone()


class RequestProgress(StatefulProcessor):
    """One request: the pages seen, what ended it, and timers in event time for silence and for forgetting.

    The clock is the rows' own: a row that comes later than `silence` after the one before finds its request failed at that
    time, whether or not a timer has told so already, so results don't depend on how rows fall into micro-batches.
    """

    def __init__(self, silence_us: int, keep_us: int):
        self.silence, self.keep = silence_us, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, pages int, over boolean")
        self.pages = handle.getMapState("pages", "page int", "seen boolean")

    def _alarm(self, micros: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-micros // 1000))

    def _end(self, kind: str, request: int, message: str | None, at: int, total: int | None = None) -> Row:
        self.pages.clear()
        self.state.update((at, 0, True))
        self._alarm(at + self.keep)
        return Row(request=request, type=kind, page=None, total=total, percent=100.0 if kind == "complete" else None, message=message, ts=_instant(at))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, pages, over = self.state.get() if self.state.exists() else (None, 0, False)
        if over:
            return
        for at, _, r in sorted(((_micros(r.ts), r.seq, r) for r in rows), key=lambda x: x[:2]):
            if last is not None and at - last > self.silence:
                yield self._end("error", key[0], "no news", last + self.silence)
                return
            if r.kind == "failed":
                yield self._end("error", key[0], r.message, at)
                return
            last = at if last is None else max(last, at)
            if r.page is None or self.pages.containsKey((r.page,)):
                continue
            self.pages.updateValue((r.page,), (True,))
            pages += 1
            yield Row(request=key[0], type="progress", page=r.page, total=r.total, percent=round(pages / r.total * 100, 1), message=None, ts=_instant(at))
            if pages >= r.total:
                yield self._end("complete", key[0], None, at, r.total)
                return
        if last is not None:
            self.state.update((last, pages, False))
            self._alarm(last + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        last, _, over = self.state.get()
        if over:
            self.state.clear()
        else:
            yield self._end("error", key[0], "no news", last + self.silence)

    def close(self) -> None:
        pass


def request_progress(work: DataFrame, silence: timedelta = timedelta(minutes=2), late: str = "10 minutes", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """(request, type, page, total, percent, message, ts) of a stream of work (request, seq, ts, kind, page, total, message).

    kind is page or failed. Each page of a request gives one progress event, the first time it is seen; percent counts the pages seen
    so far, as pages may come in any order. Once `total` of them are seen the request is complete; a failure ends it with its message, and
    so does silence for longer than `silence`, told by the next row or once the watermark, `late` behind the latest row, has passed that.
    What comes afterwards is passed over, for `keep`, after which the request is forgotten. Rows of one micro-batch are taken by
    ts, then seq; a null request has no progress. A request's state is the numbers of the pages seen. Needs the RocksDB state store.
    """
    rows = work.where("request is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    us = lambda d: d // timedelta(microseconds=1)
    return rows.groupBy("request").transformWithState(RequestProgress(us(silence), us(keep)), OUT, "append", "eventtime")


def batch_progress(work: DataFrame, silence: timedelta = timedelta(minutes=2)) -> DataFrame:
    """The same of a finished table of work, with windows alone; silence at the end is told for every request that hasn't ended."""
    from pyspark.sql import Window as W

    w = W.partitionBy("request").orderBy("ts", "seq")
    x = work.where("request is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    x = x.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("ts").over(w))
    paged = (F.col("kind") != "failed") & F.col("page").isNotNull()
    x = x.withColumn("_new", paged & (F.row_number().over(W.partitionBy("request", "page", paged).orderBy("ts", "seq")) == 1))
    x = x.withColumn("_pages", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    pause = F.expr(f"INTERVAL '{silence.total_seconds()}' SECOND")
    quiet = F.col("ts") > F.col("_before") + pause
    end = F.when(quiet, F.struct(F.lit("error").alias("type"), F.lit("no news").alias("message"), (F.col("_before") + pause).alias("ts"), F.lit(None).cast("int").alias("total")))
    end = end.when(F.col("kind") == "failed", F.struct(F.lit("error").alias("type"), F.col("message").alias("message"), F.col("ts").alias("ts"), F.lit(None).cast("int").alias("total")))
    end = end.when(F.col("_new") & (F.col("_pages") >= F.col("total")), F.struct(F.lit("complete").alias("type"), F.lit(None).cast("string").alias("message"), F.col("ts").alias("ts"), F.col("total").alias("total")))
    x = x.withColumn("_end", end).withColumn("_at", F.min(F.when(F.col("_end").isNotNull(), F.col("_n"))).over(W.partitionBy("request")))
    steps = x.where("_new and (_at is null or _n < _at or (_n = _at and _end.type = 'complete'))")
    steps = steps.select("request", F.lit("progress").alias("type"), "page", "total", F.bround(F.col("_pages") / F.col("total") * 100, 1).alias("percent"), F.lit(None).cast("string").alias("message"), "ts")
    full = F.when(F.col("_end.type") == "complete", 100.0)
    ends = x.where("_n = _at").select("request", "_end.type", F.lit(None).cast("int").alias("page"), "_end.total", full.alias("percent"), "_end.message", "_end.ts")
    open_ = x.where("_at is null").groupBy("request").agg((F.max("ts") + pause).alias("ts"))
    open_ = open_.select("request", F.lit("error").alias("type"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("double").alias("percent"), F.lit("no news").alias("message"), "ts")
    return steps.unionByName(ends).unionByName(open_)
