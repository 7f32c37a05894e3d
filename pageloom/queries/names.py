"""Names, sizes, validation and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import geometry as G
from ..functions import naming as N
from .tables import Registry, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_RAW = "CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN concat(' ', p_name, '.PDF') WHEN 2 THEN concat(p_name, ':a/b?*') WHEN 3 THEN concat('__', p_brand, '  v1.25') WHEN 4 THEN '  . _' WHEN 5 THEN '' ELSE concat(p_type, '.pdf.pdf') END"
_CLEAN = "coalesce(nullif(trim(regexp_replace(regexp_replace({x}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[\\s_]+', '_', 'g'), '._- '), ''), 'output')"
_SQL_STEM = _CLEAN.format(x="regexp_replace(raw, '\\.[a-zA-Z0-9]{2,5}$', '')")
_SQL_FILE = _CLEAN.format(x="CASE WHEN lower(raw) LIKE '%.pdf' THEN left(raw, length(raw) - 4) ELSE raw END")
_N = f"n AS (SELECT p_partkey, {_RAW} AS raw FROM part)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_RAW).alias("raw"))


@query(f"WITH {_N} SELECT p_partkey, {_SQL_FILE} || '.pdf' AS name FROM n")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", N.sanitize_filename(F.col("raw")).alias("name"))


@query(f"WITH {_N} SELECT p_partkey, {_SQL_STEM} AS stem FROM n")
def sanitize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", N.sanitize_stem(F.col("raw")).alias("stem"))


@query(f"""
WITH {_N}, s AS (SELECT p_partkey, raw, {_SQL_STEM} AS stem FROM n)
SELECT p_partkey, CASE WHEN lower(stem) LIKE '%.pdf' THEN left(stem, length(stem) - 4) ELSE stem END || '_' || left(sha256(CAST(p_partkey AS VARCHAR)), 8) || '.pdf' AS output_name,
  stem || '_unlocked.pdf' AS unlocked, lower(raw) LIKE '%.pdf' AS is_pdf FROM s""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _names(spark, sf_dir).select("p_partkey", N.output_name(raw, F.col("p_partkey")).alias("output_name"), N.unlocked_name(raw).alias("unlocked"), N.is_pdf_name(raw).alias("is_pdf"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'doc ' || page_id || '.pdf' WHEN 1 THEN url ELSE 'fallback.pdf' END AS name FROM pages""")
def header_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    disposition = F.expr("CASE page_id % 3 WHEN 0 THEN concat('attachment; filename=\"doc ', page_id, '.pdf\"') WHEN 1 THEN 'attachment; filename=\"\"' END")
    other = F.expr("CASE WHEN page_id % 3 < 2 THEN url ELSE '' END")
    return p.select("page_id", N.header_filename(disposition, other, F.lit("fallback.pdf")).alias("name"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey * c_custkey * 37 AS n FROM customer)
SELECT c_custkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.2f MB', floor(n * 100 / 1048576.0 + 0.5) / 100) END AS size FROM c""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", N.format_bytes(k * k * 37).alias("size"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'transparent' WHEN 2 THEN 'rgba(1,2,3,0.5)' ELSE '#' || printf('%06x', c_custkey * 7919 % 16777216) END AS c FROM customer)
SELECT c_custkey, CASE WHEN c = '' THEN 'transparent' WHEN c LIKE '#%' THEN printf('rgba(%d, %d, %d, %s)', c_custkey * 7919 % 16777216 // 65536, c_custkey * 7919 % 65536 // 256, c_custkey * 7919 % 256, CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' ELSE '0.75' END) ELSE c END AS rgba,
  CASE c_custkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'bold' WHEN 2 THEN 'italic' ELSE 'italic bold' END AS font FROM c""")
def canvas_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = F.expr("CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'transparent' WHEN 2 THEN 'rgba(1,2,3,0.5)' ELSE concat('#', lower(lpad(hex(c_custkey * 7919 % 16777216), 6, '0'))) END")
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", N.hex_to_rgba(color, k % 4 * 25).alias("rgba"), N.font_style(k % 2 == 1, k % 4 >= 2).alias("font"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'd' || event_id ELSE 'something went wrong' END AS message FROM events""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("CASE event_id % 4 WHEN 0 THEN concat('{\"message\": \"m', event_id, '\", \"detail\": \"x\"}') WHEN 1 THEN concat('{\"message\": \"\", \"detail\": \"d', event_id, '\"}') WHEN 2 THEN '{}' ELSE 'no json' END")
    return table(spark, sf_dir, "events").select("event_id", N.error_message(body, F.lit("something went wrong")).alias("message"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '7') WHEN 1 THEN ' ' || lpad(CAST(p_partkey AS VARCHAR), 13, '4') || ' ' WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '1') WHEN 3 THEN p_name WHEN 4 THEN '   ' ELSE lpad(CAST(p_partkey AS VARCHAR), 7, '2') END AS c,
  CASE p_partkey % 4 WHEN 0 THEN 'EAN13' WHEN 1 THEN 'ean8' WHEN 2 THEN 'code128' ELSE 'upc' END AS k FROM part)
SELECT p_partkey, CASE WHEN trim(c) = '' THEN 'content is empty' WHEN k = 'upc' THEN 'unknown symbology'
  WHEN k = 'EAN13' AND NOT regexp_full_match(trim(c), '[0-9]{12,13}') THEN 'EAN-13 takes 12 or 13 digits'
  WHEN k = 'ean8' AND NOT regexp_full_match(trim(c), '[0-9]{7,8}') THEN 'EAN-8 takes 7 or 8 digits' END AS error FROM x""")
def ean_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.expr("CASE p_partkey % 6 WHEN 0 THEN lpad(cast(p_partkey as string), 12, '7') WHEN 1 THEN concat(' ', lpad(cast(p_partkey as string), 13, '4'), ' ') WHEN 2 THEN lpad(cast(p_partkey as string), 8, '1') WHEN 3 THEN p_name WHEN 4 THEN '   ' ELSE lpad(cast(p_partkey as string), 7, '2') END")
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'EAN13' WHEN 1 THEN 'ean8' WHEN 2 THEN 'code128' ELSE 'upc' END")
    return table(spark, sf_dir, "part").select("p_partkey", C.barcode_error(content, kind, F.lit("png")).alias("error"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'content is empty' WHEN p_size % 30 < 1 OR p_size % 30 > 20 THEN 'size is not 1 to 20' WHEN p_partkey % 5 = 0 THEN 'border is negative' WHEN p_partkey % 3 = 1 THEN 'unknown format' END AS error,
  CASE p_partkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'H' ELSE 'M' END AS correction FROM part""")
def qr_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    content, form = F.when(k % 9 == 0, " ").otherwise(F.col("p_name")), F.when(k % 3 == 0, "SVG").when(k % 3 == 1, "gif").otherwise("png")
    error = C.qr_error(content, F.col("p_size") % 30, F.when(k % 5 == 0, -1).otherwise(4), form)
    return table(spark, sf_dir, "part").select("p_partkey", error.alias("error"), C.qr_correction(F.when(k % 4 == 0, "l").when(k % 4 == 1, "H").when(k % 4 == 2, "z")).alias("correction"))


@query("""
SELECT o_orderkey, CAST(512 + CASE WHEN o_orderkey % 2 = 0 THEN 4 + 2048 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 16 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 8 + 32 + 1024 + 256 ELSE 0 END AS INTEGER) AS mask FROM orders""")
def permission_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = C.permission_mask(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", mask.alias("mask"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE '' END AS title, source AS author, '' AS subject, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS keywords, 'x' AS producer, CAST(5 AS INTEGER) AS entries FROM documents""")
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("title"), F.lit("old"), F.lit("subject"), F.lit("old"), F.lit("producer"), F.lit("x"))
    k = F.col("doc_id")
    new = C.metadata_overlay(old, F.when(k % 2 == 0, F.concat(F.lit("T"), k.cast("string"))), F.col("source"), F.lit(None).cast("string"), F.when(k % 3 == 0, F.col("lang")))
    x = table(spark, sf_dir, "documents").select("doc_id", new.alias("m"))
    return x.select("doc_id", *[F.col("m")[c].alias(c) for c in ("title", "author", "subject", "keywords", "producer")], F.size("m").alias("entries"))


_PAGE = "CASE p_partkey % 5 WHEN 0 THEN 'a4' WHEN 1 THEN 'a3' WHEN 2 THEN 'letter' WHEN 3 THEN 'legal' ELSE 'match_image' END"


@query(f"""
WITH s AS (SELECT p_partkey, CAST(p_size * 13 AS DOUBLE) AS w, CAST(p_partkey % 50 * 10 AS DOUBLE) AS h, {_PAGE} AS page FROM part),
q AS (SELECT *, CASE page WHEN 'a4' THEN 595.0 WHEN 'a3' THEN 842.0 WHEN 'letter' THEN 612.0 WHEN 'legal' THEN 612.0 ELSE w END::DOUBLE AS pw, CASE page WHEN 'a4' THEN 842.0 WHEN 'a3' THEN 1191.0 WHEN 'letter' THEN 792.0 WHEN 'legal' THEN 1008.0 ELSE h END::DOUBLE AS ph FROM s),
z AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN least(pw / w, ph / h) ELSE 1.0::DOUBLE END AS scale FROM q)
SELECT p_partkey, scale, (pw - w * scale) / 2 AS x0, (ph - h * scale) / 2 AS y0, (pw - w * scale) / 2 + w * scale AS x1, (ph - h * scale) / 2 + h * scale AS y1 FROM z""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_size") * 13).cast("double"), (F.col("p_partkey") % 50 * 10).cast("double")
    page = G.page_size(F.expr(_PAGE), w, h)
    x = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), page.alias("page"))
    return x.select("p_partkey", G.letterbox(F.col("w"), F.col("h"), F.col("page.w"), F.col("page.h")).alias("b")).select("p_partkey", "b.*")


@query("""
WITH s AS (SELECT p_partkey, 100 + p_retailprice AS w, 50.0::DOUBLE * p_size AS h, 72 * (1 + p_partkey % 5) AS dpi, CASE p_partkey % 4 WHEN 0 THEN 1024 WHEN 2 THEN 4096 ELSE 2048 END AS m FROM part),
d AS (SELECT *, w * dpi / 72.0::DOUBLE AS pw, h * dpi / 72.0::DOUBLE AS ph FROM s)
SELECT p_partkey, CAST(greatest(36, trunc(CASE WHEN pw > m OR ph > m THEN dpi * least(m / pw, m / ph) ELSE dpi END)) AS INTEGER) AS dpi FROM d""")
def adaptive_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'auto' WHEN 2 THEN 'high' ELSE 'other' END")
    dpi = G.preview_dpi(F.lit(100.0) + F.col("p_retailprice"), F.lit(50.0) * F.col("p_size"), quality, F.lit(72) * (F.lit(1) + F.col("p_partkey") % 5))
    return table(spark, sf_dir, "part").select("p_partkey", dpi.alias("dpi"))


@query("""
WITH s AS (SELECT p_partkey, p_size AS w, CAST(p_partkey % 40 AS INTEGER) AS h, CAST((p_partkey % 9 - 4) * 90 AS INTEGER) AS r FROM part)
SELECT p_partkey, CAST(CASE WHEN (r + 720) % 360 = 0 THEN 0 ELSE 360 - (r + 720) % 360 END AS INTEGER) AS counterclockwise, CASE WHEN (r + 720) % 180 = 90 THEN h ELSE w END AS w, CASE WHEN (r + 720) % 180 = 90 THEN w ELSE h END AS h,
  CAST((r + 810) % 360 AS INTEGER) AS right_turn, least(2.0, greatest(0.25, 1.0 + 0.25 * (p_partkey % 13 - 6)))::DOUBLE AS zoom,
  CASE WHEN p_partkey % 100 >= 85 THEN 'high' WHEN p_partkey % 100 >= 65 THEN 'good' WHEN p_partkey % 100 >= 40 THEN 'medium' ELSE 'low' END AS quality FROM s""")
def clockwise_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    r = ((k % 9 - 4) * 90).cast("int")
    dims = G.turned(F.col("p_size"), (k % 40).cast("int"), r)
    x = table(spark, sf_dir, "part").select("p_partkey", G.clockwise(r).alias("counterclockwise"), dims.alias("d"), G.rotate_step(r, 90).alias("right_turn"), G.zoom(F.lit(1.0), k % 13 - 6, 2.0).alias("zoom"), G.quality_label(k % 100).alias("quality"))
    return x.select("p_partkey", "counterclockwise", "d.w", "d.h", "right_turn", "zoom", "quality")


@query("""
SELECT p_partkey, 800.0::DOUBLE / p_size * 1.5 AS base, (p_partkey + 400.0::DOUBLE / 2) / 1.0 * 1.5 - 400.0 / 2 AS scroll,
  CAST(least(90, floor(90 * (1 - exp(-CAST(p_partkey AS DOUBLE) * 10 / 5000)) + 0.5)) AS INTEGER) AS splash, greatest(1, floor(p_retailprice / 100 * 10 + 0.5) / 10)::DOUBLE AS font FROM part""")
def view_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", G.base_scale(F.col("p_size"), F.lit(1.5)).alias("base"), G.scroll_after_zoom(k, F.lit(400.0), F.lit(1.0), F.lit(1.5)).alias("scroll"), G.splash_progress(k.cast("double") * 10).alias("splash"), G.font_size(F.col("p_retailprice") / 100).alias("font"))


@query("""
WITH s AS (SELECT p_partkey, p_size AS w, CAST(p_partkey % 40 AS INTEGER) AS h, CASE WHEN p_partkey % 10 BETWEEN 2 AND 8 THEN p_partkey % 10 ELSE 1 END AS o FROM part)
SELECT p_partkey, CASE WHEN o >= 5 THEN h ELSE w END AS w, CASE WHEN o >= 5 THEN w ELSE h END AS h, o IN (2, 4, 5, 7) AS mirrored, CAST(CASE o WHEN 3 THEN 180 WHEN 4 THEN 180 WHEN 5 THEN 270 WHEN 6 THEN 90 WHEN 7 THEN 90 WHEN 8 THEN 270 ELSE 0 END AS INTEGER) AS rotation FROM s""")
def exif_upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", G.upright(F.col("p_size"), (k % 40).cast("int"), k % 10).alias("u")).select("p_partkey", "u.*")


_TITLE = "CASE p_partkey % 3 WHEN 0 THEN concat(p_type, ' / ', p_brand, '.pdf') WHEN 1 THEN '  ' END"
_SQL_TITLED = _CLEAN.format(x="CASE WHEN lower(t) LIKE '%.pdf' THEN left(t, length(t) - 4) ELSE t END")
_SQL_FIELD = "regexp_replace(regexp_replace(trim(raw), '[<>:\"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g')"


@query(f"""
WITH n AS (SELECT p_partkey, {_RAW} AS raw, {_TITLE} AS title FROM part), t AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN replace(raw, '.pdf', '') ELSE title END AS t FROM n)
SELECT p_partkey, {_SQL_TITLED} || '.pdf' AS titled, {_SQL_FIELD} AS field, left({_SQL_FIELD}, 8) AS short_field FROM t""")
def titled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    n = table(spark, sf_dir, "part").select("p_partkey", F.expr(_RAW).alias("raw"), F.expr(_TITLE).alias("title"))
    return n.select("p_partkey", N.titled_name(F.col("title"), raw).alias("titled"), N.field_name(raw).alias("field"), N.field_name(raw, 8).alias("short_field"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS encrypted, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE o_orderstatus END AS password FROM orders),
e AS (SELECT *, CASE WHEN trim(coalesce(password, '')) = '' THEN 'a password is needed' WHEN encrypted THEN 'already protected' END AS error FROM r)
SELECT o_orderkey, error AS protect_error, CASE WHEN NOT encrypted THEN 'not protected' END AS remove_error,
  CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed with 409' END AS message FROM e""")
def protection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    password = F.when(k % 4 == 0, " ").when(k % 4 > 1, F.col("o_orderstatus"))
    error = C.protection_error(k % 3 == 0, password)
    result = C.with_status(error, 409)
    return table(spark, sf_dir, "orders").select("o_orderkey", error.alias("protect_error"), C.removal_error(k % 3 == 0).alias("remove_error"), result["status"].alias("status"), result["message"].alias("message"))
