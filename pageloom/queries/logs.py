"""Histories, memory and one-shot downloads, from events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..shared import shared_dir
from ..sources import files, store
from .tables import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_id AS id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("action"))
    return H.append_history(e.where("id % 2 = 0"), e.where("id % 2 = 1")).select("id", "action")


@query("SELECT user_id, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def history_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", "user_id")
    return H.append_history(e.where("id % 2 = 0"), e.where("id % 2 = 1"), key="user_id", keep=3).select("user_id", "id")


@query("SELECT user_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN 7 ELSE 0 END) AS BIGINT) AS bytes, count(*) AS files FROM events GROUP BY user_id")
def memory_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = _events(spark, sf_dir).select("user_id", F.when(k % 3 == 0, k).alias("size"), F.when(k % 3 == 1, 7).alias("inner_size"))
    return H.memory_sizes(e, "user_id")


@query("""
WITH e AS (SELECT user_id AS key, event_id AS seq, event_id * 997 % 1000 AS size FROM events),
l AS (SELECT a.key, a.seq, a.size, coalesce((SELECT max(b.seq) FROM e b WHERE b.key = a.key AND b.seq <= a.seq AND b.size > 800), -1) AS since FROM e a)
SELECT key, seq AS at_seq, CAST((SELECT sum(e.size) FROM e WHERE e.key = l.key AND e.seq BETWEEN l.since AND l.seq) AS BIGINT) AS held_bytes,
  CAST((SELECT count(*) FROM e WHERE e.key = l.key AND e.seq BETWEEN l.since AND l.seq) AS INTEGER) AS held_entries FROM l""")
def session_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), k.alias("seq"), k.alias("entry"), (k * 997 % 1000).alias("size"))
    return H.eviction(e, limit=800).select("key", "at_seq", "held_bytes", "held_entries")


def edit_actions(events: DataFrame) -> DataFrame:
    """(page_id, seq, action, snapshot): clicks and purchases commit, signups delete, views undo, errors redo."""
    kind = F.col("event_type")
    action = F.when(kind == "view", "undo").when(kind == "error", "redo").when(kind == "signup", "delete").otherwise("commit")
    snapshot = F.concat(F.lit("["), (F.col("event_id") % 3).cast("string"), F.lit("]"))
    return events.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), action.alias("action"), F.when(action.isin("commit", "delete"), snapshot).alias("snapshot"))


#: A fold of actions in order, as recursion: h are a page's snapshots and c is the cursor, from 1; at most 5 are kept.
SQL_UNDO_REDO = """
WITH RECURSIVE a AS (
  SELECT user_id AS page_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, '[' || event_id % 3 || ']' AS snapshot,
    CASE event_type WHEN 'view' THEN 'undo' WHEN 'error' THEN 'redo' WHEN 'signup' THEN 'delete' ELSE 'commit' END AS action FROM events WHERE user_id IS NOT NULL),
s(page_id, n, seq, h, c) AS (
  SELECT DISTINCT page_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), ['[]'], CAST(1 AS BIGINT) FROM a
  UNION ALL
  SELECT page_id, n, seq, CASE WHEN takes THEN kept[greatest(1, len(kept) - 4):] ELSE h END,
    CASE WHEN action = 'undo' THEN greatest(1, c - 1) WHEN action = 'redo' THEN least(len(h), c + 1) WHEN takes THEN least(c + 1, 5) ELSE c END
  FROM (SELECT s.page_id, a.n, a.seq, s.h, s.c, a.action, list_append(s.h[1:s.c], a.snapshot) AS kept, a.action = 'delete' OR (a.action = 'commit' AND s.h[s.c] <> a.snapshot) AS takes
    FROM s JOIN a ON a.page_id = s.page_id AND a.n = s.n + 1))
SELECT page_id, seq, CAST(c - 1 AS INTEGER) AS cursor, CAST(len(h) AS INTEGER) AS depth, h[c] AS snapshot FROM s WHERE n > 0"""


@query(SQL_UNDO_REDO)
def undo_redo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.undo_redo(edit_actions(_events(spark, sf_dir)), keep=5)


def download_requests(events: DataFrame) -> DataFrame:
    """(token, seq, kind, path)."""
    offer = F.col("event_type").isin("click", "purchase")
    token = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    return events.select(token.alias("token"), F.col("event_id").alias("seq"), F.when(offer, "offer").otherwise("take").alias("kind"), F.when(offer, F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("path"))


@query("""
WITH r AS (SELECT 't' || user_id AS token, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'offer' ELSE 'take' END AS kind FROM events),
o AS (SELECT *, lag(kind) OVER w AS k, lag(seq) OVER w AS s FROM r WINDOW w AS (PARTITION BY token ORDER BY seq))
SELECT token, seq, CASE WHEN k = 'offer' THEN 'f' || s END AS served FROM o WHERE kind = 'take'""")
def download_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.single_use(download_requests(_events(spark, sf_dir))).where("kind = 'take'").select("token", "seq", "served")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 3 + 1 END AS entries, CASE WHEN event_id % 4 > 0 THEN 'f' || event_id || '.pdf' END AS filename, CASE WHEN event_id % 4 > 0 THEN event_id * 10 END AS size FROM events""")
def history_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as JSON; every fourth can't be read and is empty."""
    k = F.col("event_id")
    entry = F.concat(F.lit('{"id": "x", "filename": "f'), k.cast("string"), F.lit('.pdf", "action": "merge", "timestamp": 5, "size": '), (k * 10).cast("string"), F.lit("}"))
    body = F.when(k % 4 == 0, "[{broken").otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(entry, (k % 3 + 1).cast("int")), ", "), F.lit("]")))
    log = files.history_log(body)
    return _events(spark, sf_dir).select("event_id", F.size(log).alias("entries"), F.get(log, 0)["filename"].alias("filename"), F.get(log, 0)["size"].alias("size"))


@query("""
SELECT 'progress' AS type, CAST(event_id % 50 AS INTEGER) AS page, 50 AS total, event_id % 50 * 2.0::DOUBLE AS percent, event_type AS message FROM events WHERE event_id % 3 = 0""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an event stream: events, comments and blank lines."""
    k = F.col("event_id")
    page = (k % 50).cast("string")
    line = F.concat(F.lit('data: {"type": "progress", "page": '), page, F.lit(', "total": 50, "percent": '), (k % 50 * 2).cast("string"), F.lit(', "message": "'), F.col("event_type"), F.lit('"}'))
    return files.progress_events(_events(spark, sf_dir).select(F.when(k % 3 == 0, line).when(k % 3 == 1, ": still here").otherwise("").alias("value")))


@query("""
WITH d AS (SELECT lang, doc_id, sha256(text) AS text_sha256 FROM documents)
SELECT 'a.pdf' AS output_name, 2 AS version, doc_id, text_sha256 FROM d WHERE lang = 'en'
UNION ALL SELECT 'b.pdf', 1, doc_id, text_sha256 FROM d WHERE lang = 'de'
UNION ALL SELECT 'b_' || substr(sha256('r1'), 1, 8) || '.pdf', 1, doc_id, text_sha256 FROM d WHERE lang = 'es'
UNION ALL SELECT 'c_' || substr(sha256('r2'), 1, 8) || '.pdf', 1, doc_id, text_sha256 FROM d WHERE lang = 'fr'""")
def outputs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts under a name that is overwritten, one that is taken already, and one that is always made unique, by a run that is repeated."""
    to = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    of = lambda lang: d.where(F.col("lang") == lang).select("doc_id", "text")
    store.put(of("fr"), to, "a.pdf")
    store.put_new(of("de"), to, "b.pdf", "r0")
    store.put_new(of("es"), to, "b.pdf", "r1")
    store.put(of("en"), to, "a.pdf")
    store.forget(spark, to, "a.pdf")
    for _ in range(2):
        store.put_unique(of("fr"), to, "c.pdf", "r2")
    return store.read(spark, to).select("output_name", F.col("version").cast("int").alias("version"), "doc_id", F.sha2("text", 256).alias("text_sha256"))
