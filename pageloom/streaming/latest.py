"""Responses that are still wanted: of a key's requests only the latest one's response is shown, those of requests overtaken meanwhile are stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import following


def _others(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("key").alias("_key"), F.col("request_id").alias("_id"), F.col("asked").alias("_asked"))


def current_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """responses (key, request_id, answered, ...) without the stale ones: those with a newer request (key, request_id, asked) of the same key by the time of the answer.

    Requests of one instant are ordered by id; equal ones count once. Every request is told when the next one of its key overtakes it, hour
    by hour and then across hours, so no key's requests meet in one task; responses join on key and id. A response without a known request or
    a time isn't shown; repeated ones all are. Other columns stay, whatever their names.
    """
    known = requests.where("asked is not null").select("key", "request_id", "asked").distinct()
    overtaken = following(known, ["key"], ["asked", "request_id"], F.floor(F.unix_micros(F.col("asked").cast("timestamp")) / 3_600_000_000), "asked", "_until")
    overtaken = overtaken.select(F.struct("key", "request_id").alias("_of"), F.struct("_until").alias("_over"))
    mine = responses.where("answered is not null").select(F.struct("*").alias("_r"))
    same = F.col("_r.key").eqNullSafe(F.col("_of.key")) & (F.col("_r.request_id") == F.col("_of.request_id"))
    return mine.join(overtaken, same).where("_over._until is null or _over._until > _r.answered").select("_r.*")


def current_responses_stream(requests: DataFrame, responses: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """The same of two streams: a response is told once the watermark, `late` behind both streams, has passed its answer, so that no request can overtake it any more.

    A stream-stream outer join that keeps the responses without a partner. `within` is how long after its request an answer may come;
    later ones are dropped, which bounds the state to the requests and responses of that time. Rows may come in any order within `late`.
    """
    pause = F.expr(f"INTERVAL {within}")
    own = responses.where("asked is not null and key is not null").withColumn("answered", F.col("answered").cast("timestamp"))
    own = own.withColumn("asked", F.col("asked").cast("timestamp")).where(F.col("answered") <= F.col("asked") + pause).withWatermark("answered", late)
    others = _others(requests).where("_key is not null").withColumn("_asked", F.col("_asked").cast("timestamp")).withWatermark("_asked", late)
    later = (F.col("_asked") > F.col("asked")) | ((F.col("_asked") == F.col("asked")) & (F.col("_id") > F.col("request_id")))
    same = (F.col("key") == F.col("_key")) & later & (F.col("_asked") <= F.col("answered")) & (F.col("_asked") >= F.col("answered") - pause)
    return own.join(others, same, "left_outer").where("_id is null").select(*responses.columns)
