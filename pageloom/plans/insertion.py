"""Insertion of pages by rules: where each rule lands once those before it have been applied, and the document that results.

Rules: doc_id, rule_id, target_page, insert_mode (before, replace, after), n (pages that the rule brings), original_index.
What a plan says pair by pair, each rule against all earlier ones, is here sums over windows of a document's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import PAGE_SIZES, letterbox, turned
from ..functions.ranges import rule_pages
from ..functions.text import concat
from ..operators.pages import page_counts


def mode_rank(mode: Column) -> Column:
    return F.when(mode == "before", 0).when(mode == "replace", 1).when(mode == "after", 2)


def checked_rules(rules: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """rules (doc_id, rule_id, target_page, insert_mode, source_type, source_file_id, source_pages, original_index) with source_list, n and error.

    sources: (source_file_id, source_total_pages). A source that isn't there, a target outside the document, an unknown
    mode or type, and pages that can't be read, lie outside the source or are none at all, are errors; an image brings one page.
    """
    r = rules.join(page_counts(pages), "doc_id", "left").join(sources.withColumn("_known", F.lit(True)), "source_file_id", "left")
    parsed = rule_pages(F.col("source_pages"), F.coalesce("source_total_pages", F.lit(0)))
    r = r.withColumn("_p", parsed)
    image = F.col("source_type") == "image"
    error = (
        F.when(F.col("_known").isNull(), concat("no such source: ", F.coalesce("source_file_id", F.lit(""))))
        .when(F.coalesce(mode_rank(F.col("insert_mode")), F.lit(-1)) < 0, F.lit("unknown mode"))
        .when(~F.coalesce(F.col("source_type").isin("image", "pdf"), F.lit(False)), F.lit("unknown source type"))
        .when(F.col("target_page").isNull() | (F.col("target_page") < 1) | (F.col("target_page") > F.coalesce("total_pages", F.lit(0))), F.lit("target page outside the document"))
        .when(~image & F.col("_p.error").isNotNull(), F.col("_p.error"))
        .when(~image & (F.size("_p.pages") == 0), F.lit("no source pages"))
    )
    listed = F.when(image, F.array(F.lit(1))).otherwise(F.col("_p.pages"))
    r = r.withColumn("error", error).withColumn("source_list", F.when(F.col("error").isNull(), listed))
    return r.withColumn("n", F.when(F.col("error").isNull(), F.size("source_list"))).drop("_p", "_known")


def resolved(rules: DataFrame) -> DataFrame:
    """rules (doc_id, rule_id, target_page, insert_mode, n, original_index) with plan_no, from 1, and adjusted_page.

    Rules are planned by target page, before, replace, after, then original_index, then rule_id. A rule is moved by every
    one planned before it that has an earlier target, or the same and comes before the page, or replaces it while the
    rule itself comes after. One that brings n pages moves others by n, by n - 1 if it replaces.
    """
    rank = mode_rank(F.col("insert_mode"))
    r = rules.withColumn("_k", rank).withColumn("_d", F.col("n") - F.when(F.col("insert_mode") == "replace", 1).otherwise(0))
    order = ["target_page", "_k", "original_index", "rule_id"]
    doc = W.partitionBy("doc_id")
    rows_before = doc.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    upto_mode = doc.orderBy(F.struct("target_page", "_k")).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = F.sum("_d").over(W.partitionBy("doc_id", "target_page", "_k"))
    offset = F.when(F.col("_k") == 0, F.coalesce(F.sum("_d").over(rows_before), F.lit(0))).otherwise(F.sum("_d").over(upto_mode) - same)
    r = r.withColumn("adjusted_page", (F.col("target_page") + offset).cast("int")).withColumn("plan_no", F.row_number().over(doc.orderBy(*order)))
    return r.drop("_k", "_d")


def inserted(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The document after all rules: (doc_id, out_page, page_no, rule_id, source_file_id, source_page); page_no of its own pages, else null.

    rules as checked_rules gives them, without errors. Around a page stand the blocks of those before it in their order,
    the page or what replaced it, and the blocks of those after it in reverse, since each lands right after the page. A second
    replacement takes the place of the first page of the one before.
    """
    mode, seq = F.col("insert_mode"), ["original_index", "rule_id"]
    r = rules.withColumn("_i", F.row_number().over(W.partitionBy("doc_id", "target_page", "insert_mode").orderBy(*seq)))
    last = F.max("_i").over(W.partitionBy("doc_id", "target_page", "insert_mode"))
    r = r.withColumn("_last", last).select("doc_id", "target_page", "insert_mode", "rule_id", "source_file_id", "_i", "_last", F.posexplode("source_list").alias("_j", "source_page"))
    # A replacement that isn't the last loses its first page to the next one.
    r = r.where((mode != "replace") | (F.col("_i") == F.col("_last")) | (F.col("_j") > 0))
    zone = F.when(mode == "before", 0).when(mode == "replace", 1).otherwise(3)
    place = F.when(mode == "before", F.col("_i")).otherwise(-F.col("_i"))
    blocks = r.select("doc_id", F.col("target_page").alias("_at"), zone.alias("_zone"), place.alias("_place"), "_j", "rule_id", "source_file_id", "source_page", F.lit(None).cast("int").alias("page_no"))
    replaced = rules.where(mode == "replace").select("doc_id", F.col("target_page").alias("page_no")).distinct()
    own = pages.join(replaced, ["doc_id", "page_no"], "left_anti").select("doc_id", F.col("page_no").alias("_at"), F.lit(2).alias("_zone"), F.lit(0).alias("_place"), F.lit(0).alias("_j"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("source_file_id"), F.lit(None).cast("int").alias("source_page"), "page_no")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("_at", "_zone", "_place", "_j"))
    return own.unionByName(blocks).withColumn("out_page", n).select("doc_id", "out_page", "page_no", "rule_id", "source_file_id", "source_page")


def image_boxes(rules: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, rule_id, page_w, page_h, scale, x0, y0, x1, y1): the page that each image rule brings, and where the image is on it.

    The page is as large as the one that the rule names, or A4 if that has no size. pages: (doc_id, page_no, width, height);
    images: (source_file_id, width, height, rotation), turned before it is placed.
    """
    like = pages.select("doc_id", F.col("page_no").alias("target_page"), F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"))
    size = images.select("source_file_id", turned(F.col("width"), F.col("height"), F.coalesce("rotation", F.lit(0))).alias("_i"))
    x = rules.where("source_type = 'image'").join(like, ["doc_id", "target_page"], "left").join(size, "source_file_id")
    w, h = PAGE_SIZES["a4"]
    x = x.withColumn("page_w", F.coalesce("_w", F.lit(float(w)))).withColumn("page_h", F.coalesce("_h", F.lit(float(h))))
    return x.select("doc_id", "rule_id", "page_w", "page_h", letterbox(F.col("_i.w"), F.col("_i.h"), F.col("page_w"), F.col("page_h")).alias("b")).select("doc_id", "rule_id", "page_w", "page_h", "b.*")


def insertion_counts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rules_applied, final_pages)."""
    delta = rules.groupBy("doc_id").agg(F.count("*").cast("int").alias("rules_applied"), F.sum(F.when(F.col("insert_mode") == "replace", F.col("n") - 1).otherwise(F.col("n"))).alias("_d"))
    out = page_counts(pages).join(delta, "doc_id", "left")
    return out.select("doc_id", F.coalesce("rules_applied", F.lit(0)).alias("rules_applied"), (F.col("total_pages") + F.coalesce("_d", F.lit(0))).cast("int").alias("final_pages"))
