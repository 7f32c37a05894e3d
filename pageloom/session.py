"""The session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors and UTC are what the operators' error columns and the SQL oracles assume; LAST_WIN is the overlay of maps.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "pageloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
