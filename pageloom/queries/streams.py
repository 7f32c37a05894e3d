"""The stateful operators as streams over the tables' files, run until all is read."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import page_counts
from ..shared import shared_dir
from ..sources import frames, store
from ..streaming import latest as L
from ..streaming import newest
from ..streaming import progress as R
from ..streaming import state as S
from ..streaming import strokes as D
from .annotations import ORACLES as EDITS
from .annotations import drawn_samples
from .logs import SQL_UNDO_REDO, download_requests, edit_actions
from .tables import SQL_PAGES, Registry, conversation_pages, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may be one file or a folder of them


STORE = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream writes until its input is read. State is kept in RocksDB, which some stateful operators need; the session's own setting comes back."""
    spark = stream.sparkSession
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/out")
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{to}/out")


@query(SQL_UNDO_REDO)
def undo_redo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(S.undo_redo_stream(edit_actions(stream_of(spark, sf_dir, "events")), keep=5))


@query("""
WITH r AS (SELECT 't' || user_id AS token, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'offer' ELSE 'take' END AS kind FROM events),
o AS (SELECT *, lag(kind) OVER w AS k, lag(seq) OVER w AS s FROM r WINDOW w AS (PARTITION BY token ORDER BY seq))
SELECT token, seq, CASE WHEN k = 'offer' THEN 'f' || s END AS served FROM o WHERE kind = 'take'""")
def download_once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(S.single_use_stream(download_requests(stream_of(spark, sf_dir, "events"))))


@query(f"""
WITH {SQL_PAGES}
SELECT p.doc_id, 'progress' AS type, p.page_no, total, round_even(p.page_no / total::DOUBLE * 100, 1)::DOUBLE AS percent FROM p JOIN t ON p.doc_id = t.doc_id""")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = stream_of(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"))
    return drained(S.progress_stream(pages, page_counts(conversation_pages(spark, sf_dir))))


#: Bursts of events with gaps of less than three hours.
SQL_BURSTS = """
WITH e AS (SELECT user_id AS key, ts, event_id, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS burst FROM e)
SELECT key, max(ts) AS ts, max_by(event_id, ts) AS value FROM s GROUP BY key, burst"""


@query(SQL_BURSTS)
def debounced_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value"))
    return S.debounced(e, gap="3 hours")


@query(f"""
{SQL_BURSTS} HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)""")
def debounced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts that the watermark has passed when the input is read."""
    e = stream_of(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value"))
    return drained(S.debounced(e, gap="3 hours", late="10 minutes"))


def event_chunks(events: DataFrame, size: int = 37) -> DataFrame:
    """(request, seq, bytes): the events of a user as one event stream, cut every `size` bytes, within ends and within characters too.

    Every fourth frame is a comment, every fourth one isn't closed JSON.
    """
    k = F.col("event_id")
    said = F.concat(F.lit('data: {"type": "progress", "page": '), (k % 50).cast("string"), F.lit(', "total": 50, "message": "é '), "event_type", F.when(k % 4 == 2, "").otherwise('"}'))
    frame = F.when(k % 4 == 1, ": still here").otherwise(said)
    body = F.encode(F.concat(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f"))))["f"], "\n\n"), F.lit("\n\ndata: {")), "UTF-8")
    x = events.where("user_id is not null").groupBy(F.col("user_id").alias("request")).agg(body.alias("b"))
    x = x.select("request", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / size))).alias("seq"))
    return x.select("request", F.col("seq").cast("long").alias("seq"), F.substring("b", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("bytes"))


SQL_EVENTS = """
SELECT request, frame_no, 'progress' AS type, CAST(event_id % 50 AS INTEGER) AS page, 50 AS total, 'é ' || event_type AS message
FROM (SELECT user_id AS request, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no FROM events WHERE user_id IS NOT NULL) WHERE event_id % 4 IN (0, 3)"""


@query(SQL_EVENTS)
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.events(frames.frames(event_chunks(table(spark, sf_dir, "events")))).select("request", "frame_no", "type", "page", "total", "message")


@query(SQL_EVENTS)
def event_frames_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks as a stream, from files of them."""
    at = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks = event_chunks(table(spark, sf_dir, "events"))
    chunks.write.parquet(at)
    stream = spark.readStream.schema(chunks.schema).parquet(at)
    return frames.events(drained(frames.frames_stream(stream))).select("request", "frame_no", "type", "page", "total", "message")


def user_work(events: DataFrame) -> DataFrame:
    """A request for each user: errors fail it, all else is a page of as many as the user's number says."""
    user = F.col("user_id")
    total = (user % 5 + 2).cast("int")
    return events.select(user.alias("request"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("page").alias("kind"), (F.col("event_id") % total + 1).cast("int").alias("page"), total.alias("total"), F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("message"))


#: stop: the row that ends a request: after a day of silence, a failure, or all pages seen.
SQL_PROGRESS = """
WITH w AS (SELECT user_id AS request, event_id AS seq, ts, event_type = 'error' AS failed, CAST(user_id % 5 + 2 AS INTEGER) AS total FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, CAST(seq % total + 1 AS INTEGER) AS page FROM w),
n AS (SELECT *, row_number() OVER v AS n, lag(ts) OVER v AS before, NOT failed AND row_number() OVER (PARTITION BY request, page, failed ORDER BY ts, seq) = 1 AS new FROM p WINDOW v AS (PARTITION BY request ORDER BY ts, seq)),
c AS (SELECT *, CAST(sum(new::INTEGER) OVER (PARTITION BY request ORDER BY n) AS INTEGER) AS pages FROM n),
e AS (SELECT *, CASE WHEN ts > before + INTERVAL 24 HOUR THEN 'no news' WHEN failed THEN 'failed at ' || seq WHEN new AND pages >= total THEN 'complete' END AS ended FROM c),
a AS (SELECT *, min(CASE WHEN ended IS NOT NULL THEN n END) OVER (PARTITION BY request) AS stop FROM e),
o AS (
  SELECT request, 'progress' AS type, page, total, round_even(pages / total::DOUBLE * 100, 1)::DOUBLE AS percent, CAST(NULL AS VARCHAR) AS message, ts FROM a WHERE new AND (stop IS NULL OR n < stop OR (n = stop AND ended = 'complete'))
  UNION ALL SELECT request, CASE WHEN ended = 'complete' THEN 'complete' ELSE 'error' END, NULL, CASE WHEN ended = 'complete' THEN total END, CASE WHEN ended = 'complete' THEN 100.0::DOUBLE END,
    CASE WHEN ended <> 'complete' THEN ended END, CASE WHEN ended = 'no news' THEN before + INTERVAL 24 HOUR ELSE ts END FROM a WHERE n = stop
  UNION ALL SELECT request, 'error', NULL, NULL, NULL, 'no news', max(ts) + INTERVAL 24 HOUR FROM a WHERE stop IS NULL GROUP BY request HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) + INTERVAL 24 HOUR FROM w))
SELECT request, type, page, total, percent, message, CAST(epoch_us(ts) AS BIGINT) AS micros FROM o"""


def _told(progress: DataFrame) -> DataFrame:
    return progress.select("request", "type", "page", "total", "percent", "message", F.unix_micros("ts").alias("micros"))


@query(SQL_PROGRESS)
def request_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(R.batch_progress(user_work(table(spark, sf_dir, "events")), silence=timedelta(days=1)))


@query(SQL_PROGRESS.replace("<= (SELECT max(ts) + INTERVAL 24 HOUR", "<= (SELECT max(ts) - INTERVAL 10 MINUTE"))
def request_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence is told as far as the watermark has come when the input is read."""
    return _told(drained(R.request_progress(user_work(stream_of(spark, sf_dir, "events")), silence=timedelta(days=1), late="10 minutes", keep=timedelta(days=36500))))


def asked_and_answered(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every event asks anew for its user, and is answered after up to six hours."""
    e = events.where("user_id is not null and ts is not null").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("asked"))
    return e, e.withColumn("answered", F.col("asked") + F.make_dt_interval(F.lit(0), (F.col("request_id") % 7).cast("int")))


SQL_CURRENT = """
WITH e AS (SELECT user_id AS key, event_id AS request_id, ts AS asked, ts + to_hours(event_id % 7) AS answered FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT key, request_id, epoch_us(answered) AS micros FROM e
WHERE NOT EXISTS (SELECT 1 FROM e n WHERE n.key = e.key AND (n.asked > e.asked OR (n.asked = e.asked AND n.request_id > e.request_id)) AND n.asked <= e.answered)"""


@query(SQL_CURRENT)
def current_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_responses(*asked_and_answered(table(spark, sf_dir, "events"))).select("key", "request_id", F.unix_micros("answered").alias("micros"))


@query(f"{SQL_CURRENT} AND answered <= (SELECT max(asked) - INTERVAL 10 MINUTE FROM e)")
def current_responses_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As far as the watermark has come when the input is read."""
    requests, responses = asked_and_answered(stream_of(spark, sf_dir, "events"))
    return drained(L.current_responses_stream(requests, responses, within="6 hours")).select("key", "request_id", F.unix_micros("answered").alias("micros"))


@query("SELECT user_id, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 events of each user as they are kept up to date, one micro-batch after another."""
    to = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    log = stream_of(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id")
    run = log.writeStream.foreachBatch(newest.merge_newest(f"{to}/kept", key="user_id")).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    kept = store.read(spark, f"{to}/kept")
    return (table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id").limit(0) if kept is None else kept).select("user_id", "id")


@query(EDITS["annotation_draw"])
def annotation_draw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples as a stream from files of them, in three micro-batches or more, releases among them."""
    at = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    samples = drawn_samples(spark, sf_dir)
    releases = samples.groupBy("page_id", "object_id", "type").agg(F.count("*").alias("total"))
    releases.unionByName(samples, allowMissingColumns=True).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(at)
    kept = spark.read.parquet(at)
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", max(1, len(kept.inputFiles()) // 3)).parquet(at)
    parts = drained(D.drawn_stream(stream, late="36500 days")).withColumn("path", F.array_join(F.transform(F.filter("points", lambda v, i: i % 2 == 0), lambda v: v.cast("long").cast("string")), ","))
    whole = parts.groupBy("page_id", "object_id", "type").agg(F.array_sort(F.collect_list(F.struct("part", "path"))).alias("parts"))
    return whole.select("page_id", "object_id", "type", F.array_join("parts.path", ",").alias("path"))
