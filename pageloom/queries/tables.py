"""The tables as documents, and a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Requests for pages, dealt to documents in turn: right ones, and each kind of wrong one.
SPECS = ["1-2,1", "2", "1-3,5,2", "3-2", "0", "a", " ", " 2 - 3", "1-9", ",", "2,2,1-2", "1"]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, rotation, role, text): a turn is a page."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (turn + 1).cast("int").alias("page_no"), (turn * 90 % 360).cast("int").alias("rotation"), "role", "text")


def literals(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def page_requests(pages: DataFrame) -> DataFrame:
    """(doc_id, spec) for every document."""
    spec = F.element_at(literals(SPECS), (F.pmod("doc_id", F.lit(len(SPECS))) + 1).cast("int"))
    return pages.select("doc_id").distinct().withColumn("spec", spec)


SQL_LIST = "[" + ", ".join(f"'{s}'" for s in SPECS) + "]"
#: p: pages, t: totals, r: requests with totals.
SQL_PAGES = f"""p AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, CAST(turn * 90 % 360 AS INTEGER) AS rotation, role, text FROM conversations),
t AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS total FROM p GROUP BY doc_id),
r AS (SELECT doc_id, total, ({SQL_LIST})[doc_id % {len(SPECS)} + 1] AS spec FROM t)"""
#: k: parts of requests, f: first error of each request, g: pages of requests without error by part.
SQL_GROUPS = (
    SQL_PAGES
    + """,
k0 AS (SELECT doc_id, total, spec, unnest(range(1, len(string_split(spec, ',')) + 1)) AS i FROM r),
k1 AS (SELECT doc_id, total, i, trim(string_split(spec, ',')[i]) AS tok FROM k0),
k AS (SELECT doc_id, total, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, tok,
  try_cast(string_split(tok, '-')[1] AS BIGINT) AS a, try_cast(string_split(tok, '-')[-1] AS BIGINT) AS b,
  regexp_full_match(tok, '[0-9]+(-[0-9]+)?') AS ok FROM k1 WHERE tok <> ''),
f AS (SELECT r.doc_id, r.total, CASE WHEN trim(r.spec) = '' THEN 'no pages given' ELSE x.error END AS error
  FROM r LEFT JOIN (SELECT doc_id, min_by(error, i) AS error FROM (
    SELECT doc_id, i, CASE WHEN NOT ok THEN '''' || tok || ''' is not a page or a range'
      WHEN a < 1 OR b > total THEN '''' || tok || ''' is outside pages 1-' || total
      WHEN a > b THEN '''' || tok || ''' runs backwards' END AS error FROM k) WHERE error IS NOT NULL GROUP BY doc_id) x ON r.doc_id = x.doc_id),
g AS (SELECT k.doc_id, k.i, CAST(unnest(range(a, b + 1)) AS INTEGER) AS page_no FROM k JOIN f ON k.doc_id = f.doc_id WHERE f.error IS NULL)"""
)
