"""Selecting, splitting, joining and reordering pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import is_shown, rule_pages, shown_pages
from ..operators import intervals as V
from ..operators import pages as P
from ..sources.files import document_info
from .tables import SQL_GROUPS, SQL_PAGES, Registry, conversation_pages, literals, page_requests

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(f"""
WITH {SQL_GROUPS}, o AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY i, page_no) AS out_page FROM g)
SELECT o.doc_id, o.page_no, CAST(o.out_page AS INTEGER) AS out_page, p.role, md5(p.text) AS text_md5, CAST(NULL AS VARCHAR) AS error
FROM o JOIN p ON o.doc_id = p.doc_id AND o.page_no = p.page_no
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, error FROM f WHERE error IS NOT NULL""")
def extract_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    return P.extract_combined(pages, page_requests(pages)).select("doc_id", "page_no", "out_page", "role", F.md5("text").alias("text_md5"), "error")


@query(f"""
WITH {SQL_GROUPS}, o AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS n FROM (SELECT DISTINCT doc_id, page_no FROM g))
SELECT o.doc_id, o.page_no, CAST(n AS INTEGER) AS entry_no, printf('conv_%d_page%04d.pdf', o.doc_id, o.page_no) AS entry_name, p.role, CAST(NULL AS VARCHAR) AS error
FROM o JOIN p ON o.doc_id = p.doc_id AND o.page_no = p.page_no
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, error FROM f WHERE error IS NOT NULL""")
def extract_separate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    stem = F.format_string("conv %d.pdf", "doc_id")
    return P.extract_pages(pages, page_requests(pages), stem).select("doc_id", "page_no", "entry_no", "entry_name", "role", "error")


@query(f"""
WITH {SQL_GROUPS}, b AS (SELECT doc_id, i, min(page_no) AS lo, max(page_no) AS hi FROM g GROUP BY doc_id, i)
SELECT g.doc_id, g.page_no, CAST(g.i AS INTEGER) AS entry_no, CAST(g.page_no - lo + 1 AS INTEGER) AS out_page,
  'conv_' || g.doc_id || '_page' || lo || CASE WHEN lo < hi THEN '-' || hi ELSE '' END || '.pdf' AS entry_name, p.role, CAST(NULL AS VARCHAR) AS error
FROM g JOIN b ON g.doc_id = b.doc_id AND g.i = b.i JOIN p ON g.doc_id = p.doc_id AND g.page_no = p.page_no
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, error FROM f WHERE error IS NOT NULL""")
def extract_separate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    stem = F.format_string("conv %d.pdf", "doc_id")
    return P.extract_ranges(pages, page_requests(pages), stem).select("doc_id", "page_no", "entry_no", "out_page", "entry_name", "role", "error")


@query(f"""WITH {SQL_PAGES} SELECT doc_id, page_no, page_no AS entry_no, 'conv_' || doc_id || '_page' || page_no || '.pdf' AS entry_name FROM p""")
def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_all(conversation_pages(spark, sf_dir), F.format_string("conv %d", "doc_id")).select("doc_id", "page_no", "entry_no", "entry_name")


@query(f"""
WITH {SQL_GROUPS}, n AS (SELECT doc_id, count(*) AS n, count(DISTINCT page_no) AS d FROM g GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN error IS NULL THEN CAST(coalesce(n, 0) AS INTEGER) END AS pages_extracted, CASE WHEN error IS NULL THEN CAST(coalesce(d, 0) AS INTEGER) END AS files, error
FROM f LEFT JOIN n ON f.doc_id = n.doc_id""")
def pages_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    return P.pages_extracted(pages, page_requests(pages))


_RULE_SPEC = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '2-1,1' WHEN 2 THEN total || '-1,1-2' ELSE '1,x' END"


@query(f"""
WITH {SQL_PAGES}
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN list_transform(range(1, total + 1), lambda x: CAST(x AS INTEGER))
  WHEN 1 THEN CASE WHEN total >= 2 THEN [CAST(2 AS INTEGER), 1, 1] END
  WHEN 2 THEN CASE WHEN total >= 2 THEN list_transform(list_concat(range(total, 0, -1), [CAST(1 AS BIGINT), 2]), lambda x: CAST(x AS INTEGER)) END END AS pages,
  CASE WHEN doc_id % 4 = 3 THEN '''x'' is not a page or a range' WHEN doc_id % 4 = 1 AND total < 2 THEN '''2-1'' is outside pages 1-1'
    WHEN doc_id % 4 = 2 AND total < 2 THEN '''1-2'' is outside pages 1-1' END AS error FROM t""")
def range_rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.page_counts(conversation_pages(spark, sf_dir)).withColumnRenamed("total_pages", "total")
    return t.select("doc_id", rule_pages(F.expr(_RULE_SPEC), F.col("total")).alias("x")).select("doc_id", "x.pages", "x.error")


@query(f"""
WITH {SQL_PAGES}
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN list_transform(range(1, total + 1), lambda x: CAST(x AS INTEGER))
  WHEN 1 THEN list_filter([CAST(1 AS INTEGER), 2, 3], lambda x: x <= total) WHEN 2 THEN list_filter([CAST(1 AS INTEGER), 2], lambda x: x <= total)
  WHEN 3 THEN list_filter([CAST(5 AS INTEGER)], lambda x: x <= total) WHEN 4 THEN [] ELSE list_transform(range(2, total + 1), lambda x: CAST(x AS INTEGER)) END AS shown,
  CASE doc_id % 6 WHEN 1 THEN total >= 2 WHEN 3 THEN false WHEN 4 THEN false ELSE total >= 2 END AS has_second FROM t""")
def range_ui_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.page_counts(conversation_pages(spark, sf_dir))
    spec = F.expr("CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN '3,1,2,3' WHEN 2 THEN '1-2-3' WHEN 3 THEN '5abc,0,99' WHEN 4 THEN '5-3,x,-' ELSE '2-99' END")
    return t.select("doc_id", shown_pages(spec, F.col("total_pages")).alias("shown"), is_shown(F.lit(2), spec, F.col("total_pages")).alias("has_second"))


@query(f"""
WITH {SQL_PAGES}, i AS (SELECT doc_id // 3 AS output_id, doc_id % 3 AS input_no, doc_id, total, count(*) OVER (PARTITION BY doc_id // 3) AS n,
  coalesce(sum(total) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id % 3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT output_id, i.doc_id, p.page_no, CAST(before + p.page_no AS INTEGER) AS out_page, CAST(NULL AS VARCHAR) AS error FROM i JOIN p ON i.doc_id = p.doc_id WHERE n > 1
UNION ALL SELECT DISTINCT output_id, NULL, NULL, NULL, 'fewer than two inputs' FROM i WHERE n < 2""")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    inputs = pages.select("doc_id").distinct().select(F.expr("doc_id div 3").alias("output_id"), (F.col("doc_id") % 3).alias("input_no"), "doc_id")
    return P.merge(pages, inputs).select("output_id", "doc_id", "page_no", "out_page", "error")


@query(f"""
WITH {SQL_PAGES}, c AS (SELECT doc_id, total, unnest([1, 2, 3]) AS out_page FROM t WHERE doc_id % 5 < 4),
d AS (SELECT doc_id, out_page, CASE out_page WHEN 1 THEN total WHEN 2 THEN 1 ELSE total END AS page_no, CASE out_page WHEN 1 THEN 90 WHEN 2 THEN 0 ELSE -180 END AS turn FROM c WHERE doc_id % 5 < 2)
SELECT d.doc_id, d.page_no, CAST(d.out_page AS INTEGER) AS out_page, CAST((p.rotation + turn + 720) % 360 AS INTEGER) AS rotation, CAST(NULL AS VARCHAR) AS error FROM d JOIN p ON d.doc_id = p.doc_id AND d.page_no = p.page_no
UNION ALL SELECT doc_id, NULL, NULL, 0, CASE doc_id % 5 WHEN 2 THEN 'no pages left' WHEN 3 THEN 'no page 99' ELSE 'not a list of pages' END FROM t WHERE doc_id % 5 >= 2""")
def organize_gather_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    config = F.expr(
        """CASE doc_id % 5 WHEN 2 THEN '[]' WHEN 3 THEN '[{"page": 99}]' WHEN 4 THEN '{"page": 1}'
        ELSE concat('[{"page": ', total_pages, ', "rotation": 90}, {}, {"page": ', total_pages, ', "rotation": -180}]') END"""
    )
    configs = P.page_counts(pages).select("doc_id", config.alias("config"))
    return P.organize(pages, configs).select("doc_id", "page_no", "out_page", "rotation", "error")


@query(f"""
WITH {SQL_PAGES}, a AS (SELECT p.doc_id, p.page_no, p.role, unnest(CASE WHEN p.page_no = doc_id % 3 + 1 THEN [0, 1] ELSE [CASE WHEN p.page_no > doc_id % 3 + 1 THEN 1 ELSE 0 END] END) AS s FROM p)
SELECT doc_id, CAST(page_no + s AS INTEGER) AS page_no, role FROM a""")
def page_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_at(conversation_pages(spark, sf_dir), F.col("doc_id") % 3).select("doc_id", "page_no", "role")


@query(f"""WITH {SQL_PAGES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS page_no, role FROM p WHERE page_no <> doc_id % 3 + 1""")
def page_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.remove_at(conversation_pages(spark, sf_dir), F.col("doc_id") % 3).select("doc_id", "page_no", "role")


@query(f"""WITH {SQL_PAGES} SELECT doc_id, page_no, CAST(CASE WHEN page_no = doc_id % 3 + 1 THEN (rotation + 90) % 360 ELSE rotation END AS INTEGER) AS rotation FROM p""")
def page_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rotate_at(conversation_pages(spark, sf_dir), F.col("doc_id") % 3).select("doc_id", "page_no", "rotation")


@query(f"""
WITH {SQL_PAGES}, m AS (SELECT p.doc_id, page_no, role, total, CAST(0 AS INTEGER) AS a, total - 1 AS b FROM p JOIN t ON p.doc_id = t.doc_id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_no - 1 = CASE WHEN doc_id % 2 = 0 THEN a ELSE b END
  THEN CASE WHEN doc_id % 2 = 0 THEN total + 0.5 ELSE 0.5 END ELSE page_no END) AS INTEGER) AS page_no, role FROM m""")
def page_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    pages = pages.join(P.page_counts(pages), "doc_id")
    even, last = F.col("doc_id") % 2 == 0, F.col("total_pages") - 1
    return P.move(pages, F.when(even, 0).otherwise(last), F.when(even, last).otherwise(0)).select("doc_id", "page_no", "role")


@query(f"""
WITH {SQL_PAGES}, s AS (SELECT p.doc_id, page_no, role, total, doc_id % 4 + 1 AS x FROM p JOIN t USING (doc_id))
SELECT doc_id, CAST(CASE WHEN x > total OR x + 1 > total THEN page_no WHEN page_no = x THEN x + 1 WHEN page_no = x + 1 THEN x ELSE page_no END AS INTEGER) AS page_no, role FROM s""")
def page_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.swap_neighbour(conversation_pages(spark, sf_dir), F.col("doc_id") % 4, 1).select("doc_id", "page_no", "role")


@query(f"""
WITH {SQL_PAGES}, u AS (SELECT doc_id, total, list_sort(list_distinct(CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [1, 2, 3] END)) AS s, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS c FROM t),
v AS (SELECT doc_id, total, list_sort(CASE WHEN list_contains(s, c) THEN list_filter(s, lambda x: x <> c) ELSE list_append(s, c) END) AS s FROM u)
SELECT doc_id, CASE WHEN len(s) = total THEN '' ELSE array_to_string(s, ', ') END AS selection FROM v""")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.page_counts(conversation_pages(spark, sf_dir))
    selected = F.expr("CASE WHEN doc_id % 2 = 0 THEN array(1, 2) ELSE array(1, 2, 3) END")
    clicked = F.expr("CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END")
    return t.select("doc_id", P.toggle_page(selected, clicked, F.col("total_pages")).alias("selection"))


@query(f"""
WITH {SQL_GROUPS}, q AS (SELECT doc_id, page_no FROM g UNION SELECT f.doc_id, p.page_no FROM f JOIN p ON f.doc_id = p.doc_id JOIN r ON f.doc_id = r.doc_id WHERE trim(r.spec) = ''),
n AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS out_page FROM q)
SELECT doc_id, page_no, CAST(out_page AS INTEGER) AS out_page, CAST(NULL AS VARCHAR) AS error FROM n
UNION ALL SELECT f.doc_id, NULL, NULL, coalesce(error, 'no pages selected') FROM f JOIN r ON f.doc_id = r.doc_id WHERE trim(r.spec) <> '' AND f.doc_id NOT IN (SELECT doc_id FROM q)""")
def render_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    return P.select_for_rendering(pages, page_requests(pages)).select("doc_id", "page_no", "out_page", "error")


@query(f"""
WITH {SQL_PAGES}, a AS (SELECT doc_id, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY CASE WHEN doc_id % 2 = 0 THEN page_no ELSE -page_no END) AS now, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS first FROM p GROUP BY doc_id)
SELECT doc_id, now <> first AS needs_reset FROM a""")
def order_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list("page_no")).alias("first"))
    now = F.when(F.col("doc_id") % 2 == 0, F.col("first")).otherwise(F.reverse("first"))
    return x.select("doc_id", P.needs_reset(now, F.col("first")).alias("needs_reset"))


@query(f"""WITH {SQL_PAGES} SELECT doc_id, CAST(count(*) AS INTEGER) AS total_pages, CAST(sum(octet_length(encode(text))) AS BIGINT) AS file_size_bytes FROM p GROUP BY doc_id""")
def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_info(conversation_pages(spark, sf_dir), F.octet_length("text"))


def page_edits(totals: DataFrame) -> DataFrame:
    """Sixteen edits of each document, some of them outside it."""
    x = totals.select("doc_id", "total_pages", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("seq"))
    k = F.col("doc_id") * 7 + F.col("seq") * 11
    op = F.element_at(literals(["remove", "rotate", "duplicate", "move", "swap"]), (k % 5 + 1).cast("int"))
    at = k % (F.col("total_pages") + 1)
    to = F.when(k % 5 == 1, 90).when(k % 5 == 3, F.col("doc_id") * 3 % (F.col("total_pages") + 1)).when(k % 5 == 4, F.col("seq") % 2 * 2 - 1)
    return x.select("doc_id", "seq", op.alias("op"), at.alias("at"), to.alias("to"))


#: A list of pages as numbers page * 360 + rotation, edited in turn.
@query(f"""
WITH RECURSIVE {SQL_PAGES},
e AS (SELECT doc_id, seq, k % 5 AS op, k % (total + 1) AS a, CASE k % 5 WHEN 3 THEN doc_id * 3 % (total + 1) ELSE k % (total + 1) + seq % 2 * 2 - 1 END AS b
  FROM (SELECT doc_id, total, seq, doc_id * 7 + seq * 11 AS k FROM (SELECT doc_id, total, unnest(range(0, 16)) AS seq FROM t))),
s(doc_id, seq, l) AS (
  SELECT doc_id, CAST(0 AS BIGINT), list(CAST(page_no * 360 + rotation AS BIGINT) ORDER BY page_no) FROM p GROUP BY doc_id
  UNION ALL
  SELECT s.doc_id, s.seq + 1, CASE WHEN a >= len(l) OR (op >= 3 AND (b < 0 OR b >= len(l))) THEN l
    WHEN op = 0 THEN list_concat(l[1 : a], l[a + 2 :])
    WHEN op = 1 THEN list_concat(l[1 : a], list_concat([l[a + 1] // 360 * 360 + (l[a + 1] + 90) % 360], l[a + 2 :]))
    WHEN op = 2 THEN list_concat(l[1 : a + 1], l[a + 1 :])
    ELSE list_concat(list_concat(l[1 : a], l[a + 2 :])[1 : b], list_concat([l[a + 1]], list_concat(l[1 : a], l[a + 2 :])[b + 1 :])) END
  FROM s JOIN e ON s.doc_id = e.doc_id AND s.seq = e.seq),
o AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s WHERE seq = 16)
SELECT doc_id, CAST(i AS INTEGER) AS page_no, CAST(l[i] % 360 AS INTEGER) AS rotation, l[i] // 360 AS source_page FROM o""")
def page_edits_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir).withColumn("source_page", F.col("page_no").cast("long"))
    return V.edited(pages, page_edits(P.page_counts(pages))).select("doc_id", "page_no", "rotation", "source_page")
