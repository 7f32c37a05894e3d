"""Planning and executing insertions: events are rules, conversations the documents, parts the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import insertion as I
from ..sources.files import rules_from_json
from .tables import SQL_PAGES, Registry, conversation_pages, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_MODE = "CASE WHEN event_type IN ('click', 'view') THEN 'before' WHEN event_type = 'purchase' THEN 'replace' ELSE 'after' END"
_SPEC = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1-2' WHEN 2 THEN '2,1,2' ELSE '9' END"
_SOURCE = "CASE WHEN event_id % 17 = 0 THEN 'missing' ELSE CAST(event_id % 100 + 1 AS VARCHAR(20)) END"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("doc_id"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rule_id"),
        (F.col("event_id") % 9).cast("int").alias("target_page"),
        F.expr(_MODE).alias("insert_mode"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'pdf' END").alias("source_type"),
        F.expr(_SOURCE).cast("string").alias("source_file_id"),
        F.expr(_SPEC).alias("source_pages"),
        (F.col("event_id") % 5).cast("int").alias("original_index"),
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_file_id"), (F.col("p_size") % 5 + 1).cast("int").alias("source_total_pages"))
    return I.checked_rules(_rules(spark, sf_dir), sources, conversation_pages(spark, sf_dir))


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where("error is null").select("doc_id", "rule_id", "target_page", "insert_mode", "source_file_id", "source_list", "n", "original_index")


#: c: checked rules with error and n.
_SQL = f"""{SQL_PAGES}, e AS (
  SELECT user_id AS doc_id, 'r' || event_id AS rule_id, CAST(event_id % 9 AS INTEGER) AS target_page, {_MODE} AS insert_mode,
    CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'pdf' END AS source_type, {_SOURCE} AS source_file_id, {_SPEC} AS spec, CAST(event_id % 5 AS INTEGER) AS original_index FROM events),
s AS (SELECT CAST(p_partkey AS VARCHAR) AS source_file_id, CAST(p_size % 5 + 1 AS INTEGER) AS st FROM part),
c AS (SELECT e.*, st, CASE WHEN st IS NULL THEN 'no such source: ' || e.source_file_id
    WHEN target_page < 1 OR target_page > coalesce(total, 0) THEN 'target page outside the document'
    WHEN source_type = 'pdf' AND spec = '1-2' AND st < 2 THEN '''1-2'' is outside pages 1-1'
    WHEN source_type = 'pdf' AND spec = '2,1,2' AND st < 2 THEN '''2'' is outside pages 1-1'
    WHEN source_type = 'pdf' AND spec = '9' THEN '''9'' is outside pages 1-' || st END AS error,
  CASE WHEN source_type = 'image' THEN [CAST(1 AS BIGINT)] WHEN spec = '' THEN range(1, st + 1) WHEN spec = '1-2' THEN [CAST(1 AS BIGINT), 2] ELSE [CAST(2 AS BIGINT), 1, 2] END AS listed
  FROM e LEFT JOIN t ON e.doc_id = t.doc_id LEFT JOIN s ON e.source_file_id = s.source_file_id),
o AS (SELECT *, CAST(len(listed) AS INTEGER) AS n, CASE insert_mode WHEN 'before' THEN 0 WHEN 'replace' THEN 1 ELSE 2 END AS k FROM c WHERE error IS NULL)"""


@query(f"WITH {_SQL} SELECT doc_id, rule_id, target_page, CASE WHEN error IS NULL THEN CAST(len(listed) AS INTEGER) END AS n, error FROM c")
def insertion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_id", "rule_id", "target_page", "n", "error")


@query(f"""
WITH {_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY target_page, k, original_index, rule_id) AS plan_no FROM o)
SELECT b.doc_id, b.rule_id, b.insert_mode, CAST(b.plan_no AS INTEGER) AS plan_no,
  CAST(b.target_page + coalesce(sum(CASE WHEN a.k = 1 THEN a.n - 1 ELSE a.n END), 0) AS INTEGER) AS adjusted_page
FROM w b LEFT JOIN w a ON a.doc_id = b.doc_id AND a.plan_no < b.plan_no
  AND (a.target_page < b.target_page OR a.k = 0 OR (a.k = 1 AND b.k = 2))
GROUP BY b.doc_id, b.rule_id, b.insert_mode, b.plan_no, b.target_page""")
def insertion_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolved(_good(spark, sf_dir)).select("doc_id", "rule_id", "insert_mode", "plan_no", "adjusted_page")


@query(f"""
WITH {_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_page, k ORDER BY original_index, rule_id) AS i, count(*) OVER (PARTITION BY doc_id, target_page, k) AS m FROM o),
b AS (SELECT doc_id, target_page, k, i, m, rule_id, source_file_id, listed, unnest(range(1, len(listed) + 1)) AS j FROM w),
u AS (SELECT doc_id, target_page AS pos, CASE k WHEN 2 THEN 3 ELSE k END AS zone, CASE k WHEN 0 THEN i ELSE -i END AS place, j, NULL AS page_no, rule_id, source_file_id, CAST(listed[j] AS INTEGER) AS source_page
    FROM b WHERE k <> 1 OR i = m OR j > 1
  UNION ALL SELECT p.doc_id, p.page_no, 2, 0, 0, p.page_no, NULL, NULL, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = p.doc_id AND o.target_page = p.page_no AND o.k = 1))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, zone, place, j) AS INTEGER) AS out_page, CAST(page_no AS INTEGER) AS page_no, rule_id, source_file_id, source_page FROM u""")
def insertion_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inserted(conversation_pages(spark, sf_dir), _good(spark, sf_dir))


@query(f"""
WITH {_SQL}, d AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN k = 1 THEN n - 1 ELSE n END) AS d FROM o GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS rules_applied, CAST(total + coalesce(d, 0) AS INTEGER) AS final_pages FROM t LEFT JOIN d ON t.doc_id = d.doc_id""")
def insertion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.insertion_counts(conversation_pages(spark, sf_dir), _good(spark, sf_dir))


@query("""
SELECT 'r' || event_id AS rule_id, CASE WHEN event_id % 17 = 0 THEN 'missing' ELSE CAST(event_id % 100 + 1 AS VARCHAR) END AS source_file_id FROM events
WHERE event_id % 17 = 0 OR (event_id % 100 + 1) NOT IN (SELECT p_partkey FROM part)""")
def rule_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_file_id"))
    return _rules(spark, sf_dir).join(sources, "source_file_id", "left_anti").select("rule_id", "source_file_id")


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(0 AS INTEGER) END AS input_no, CASE WHEN event_id % 4 < 2 THEN 'e' || event_id END AS rule_id,
  CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 6 AS INTEGER) END AS target_page, CASE WHEN event_id % 4 >= 2 THEN 'not a list of rules' END AS error FROM events""")
def rules_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("CASE event_id % 4 WHEN 2 THEN '{}' WHEN 3 THEN '[{' ELSE concat('[{\"rule_id\": \"e', event_id, '\", \"target_page\": ', event_id % 6, '}]') END")
    x = table(spark, sf_dir, "events").select("event_id", body.alias("rules"))
    return rules_from_json(x).select("event_id", "input_no", "rule_id", "target_page", "error")


@query(f"""
WITH {_SQL}, z AS (SELECT doc_id, page_no, CASE WHEN page_no % 2 = 0 THEN 612.0 ELSE 842.0 END::DOUBLE AS w, CAST(500 + page_no AS DOUBLE) AS h FROM p),
m AS (SELECT CAST(p_partkey AS VARCHAR) AS source_file_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_partkey % 40 END AS DOUBLE) AS w, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 ELSE p_size END AS DOUBLE) AS h FROM part),
k AS (SELECT c.doc_id, rule_id, z.w AS pw, z.h AS ph, m.w, m.h, CASE WHEN m.w > 0 AND m.h > 0 THEN least(z.w / m.w, z.h / m.h) ELSE 1.0::DOUBLE END AS scale
  FROM c JOIN z ON c.doc_id = z.doc_id AND c.target_page = z.page_no JOIN m ON c.source_file_id = m.source_file_id WHERE c.error IS NULL AND c.source_type = 'image')
SELECT doc_id, rule_id, pw AS page_w, ph AS page_h, scale, (pw - w * scale) / 2 AS x0, (ph - h * scale) / 2 AS y0, (pw - w * scale) / 2 + w * scale AS x1, (ph - h * scale) / 2 + h * scale AS y1 FROM k""")
def insertion_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir).select("doc_id", "page_no", F.when(F.col("page_no") % 2 == 0, 612.0).otherwise(842.0).alias("width"), (F.col("page_no") + 500).alias("height"))
    k = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(k.cast("string").alias("source_file_id"), F.col("p_size").cast("long").alias("width"), (k % 40).alias("height"), F.when(k % 2 == 0, 180).otherwise(270).alias("rotation"))
    return I.image_boxes(_checked(spark, sf_dir).where("error is null"), pages, images)
