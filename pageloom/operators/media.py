"""Accounting of embedded images and compression, and the routing of rendered pages. Pixels are a codec's work, not ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import letterbox, page_size, preview_dpi, turned
from ..functions.text import concat

# How rendered pages are encoded.
ENCODING = {"jpeg": {"quality": 90, "optimize": True}, "png": {"optimize": True}, "webp": {"quality": 90}}


def percent(part: Column, whole: Column) -> Column:
    """part / whole in per cent with one decimal, halves to even."""
    return F.bround(part / whole * 100, 1)


def first_uses(images: DataFrame) -> DataFrame:
    """images (doc_id, page_no, ordinal, xref, ...) with `first`: whether no earlier place of the document has the same xref."""
    w = W.partitionBy("doc_id", "xref").orderBy("page_no", "ordinal")
    return images.withColumn("first", F.row_number().over(w) == 1)


def reencoded(images: DataFrame) -> DataFrame:
    """first_uses with `result`: what happens to each image, and `kept_bytes`.

    images also: width, height, mode, bytes_len, new_len (bytes after re-encoding, null if that failed). An image is
    skipped if it was met before, has no size, or has a mode that isn't written; it is kept as it is unless smaller.
    """
    x = first_uses(images)
    result = (
        F.when(~F.col("first"), "shared")
        .when(F.coalesce(F.col("width") * F.col("height"), F.lit(0)) <= 0, "no size")
        .when(~F.coalesce(F.col("mode").isin("RGB", "L", "RGBA", "P", "CMYK"), F.lit(False)), "mode skipped")
        .when(F.col("new_len").isNull(), "unreadable")
        .when(F.col("new_len") >= F.col("bytes_len"), "not smaller")
        .otherwise("replaced")
    )
    x = x.withColumn("result", result)
    return x.withColumn("kept_bytes", F.when(F.col("result") == "shared", 0).when(F.col("result") == "replaced", F.col("new_len")).otherwise(F.col("bytes_len")).cast("long"))


def written_mode(mode: Column) -> Column:
    """The mode that an image is re-encoded in; null if it is skipped."""
    return F.when(mode.isin("RGBA", "P", "CMYK"), "RGB").when(mode.isin("RGB", "L"), mode)


def compression(images: DataFrame) -> DataFrame:
    """(doc_id, pages_processed, images_found, images_processed, size_before, size_after, reduction_percent, kept_original).

    A document that didn't become smaller stays as it was, at 0.0 per cent.
    """
    x = reencoded(images).groupBy("doc_id").agg(
        F.countDistinct("page_no").cast("int").alias("pages_processed"),
        F.count_if("first").cast("int").alias("images_found"),
        F.count_if(F.col("result") == "replaced").cast("int").alias("images_processed"),
        F.sum(F.when(F.col("first"), F.col("bytes_len")).otherwise(0)).cast("long").alias("size_before"),
        F.sum("kept_bytes").cast("long").alias("_after"),
    )
    worse = (F.col("_after") >= F.col("size_before")) | (F.col("size_before") == 0)
    x = x.withColumn("kept_original", worse).withColumn("size_after", F.when(worse, F.col("size_before")).otherwise(F.col("_after")))
    return x.withColumn("reduction_percent", F.when(worse, 0.0).otherwise(F.bround((1 - F.col("size_after") / F.nullif("size_before", F.lit(0))) * 100, 1))).drop("_after")


def images_per_page(images: DataFrame) -> DataFrame:
    """(doc_id, page_no, replaced): by page, and with a null page_no by document."""
    return reencoded(images).rollup("doc_id", "page_no").agg(F.count_if(F.col("result") == "replaced").cast("int").alias("replaced")).where("doc_id is not null")


def progress(pages: DataFrame) -> DataFrame:
    """A progress event for every page (doc_id, page_no), then one that the document is complete."""
    total = F.count("*").over(W.partitionBy("doc_id"))
    steps = pages.select("doc_id", F.lit("progress").alias("type"), "page_no", total.cast("int").alias("total"))
    steps = steps.withColumn("percent", percent(F.col("page_no"), F.col("total")))
    done = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
    return steps.unionByName(done.select("doc_id", F.lit("complete").alias("type"), (F.col("total") + 1).alias("page_no"), "total", F.lit(100.0).alias("percent")))


def rendering_plan(pages: DataFrame, image_format: str) -> DataFrame:
    """pages (doc_id, page_no, stem) with entry_name and archive: one page is an image, more are an archive of them."""
    ext = {"jpeg": "jpg"}.get(image_format, image_format)
    w = W.partitionBy("doc_id")
    name = F.format_string(f"%s_page%04d.{ext}", "stem", "page_no")
    archive = F.when(F.count("*").over(w) > 1, concat(F.col("stem"), "_images.zip"))
    return pages.withColumn("entry_name", name).withColumn("archive", archive)


def image_document(images: DataFrame, size: Column) -> DataFrame:
    """(doc_id, ordinal, page_no, page_w, page_h, x0, y0, x1, y1, error): images (doc_id, ordinal, width, height, rotation, error) as pages of a document.

    size: a page size by name, of images. Images that failed are left out and the rest close up; a document without any
    good one is an error row.
    """
    good = images.where("error is null").withColumn("_i", turned(F.col("width"), F.col("height"), F.coalesce("rotation", F.lit(0))))
    good = good.withColumn("page_no", F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal"))).withColumn("_p", page_size(size, F.col("_i.w"), F.col("_i.h")))
    good = good.withColumn("_b", letterbox(F.col("_i.w"), F.col("_i.h"), F.col("_p.w"), F.col("_p.h")))
    good = good.select("doc_id", "ordinal", "page_no", F.col("_p.w").alias("page_w"), F.col("_p.h").alias("page_h"), *[F.col(f"_b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    bad = best_effort(images).where("error is not null").select("doc_id", "error")
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def preview_plan(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (doc_id, page_no, quality, dpi) with the resolution to render the page at, or an error and its status.

    pages: (doc_id, page_no, width, height, is_encrypted). An unknown document is 404, an encrypted one 403, a page
    outside it 422.
    """
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("_total"), F.bool_or("is_encrypted").alias("_locked"))
    x = requests.join(docs, "doc_id", "left").join(pages.select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"], "left")
    status = F.when(F.col("_total").isNull(), 404).when(F.col("_locked"), 403).when((F.col("page_no") < 1) | (F.col("page_no") > F.col("_total")), 422).otherwise(200)
    x = x.withColumn("status", status)
    error = F.when(F.col("status") == 404, "no such document").when(F.col("status") == 403, "the document is protected").when(F.col("status") == 422, concat("no page ", F.col("page_no").cast("string")))
    x = x.withColumn("error", error).withColumn("render_dpi", F.when(F.col("status") == 200, preview_dpi(F.col("width"), F.col("height"), F.col("quality"), F.col("dpi"))))
    return x.drop("_total", "_locked", "width", "height")


def best_effort(items: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, good, failed, error) of items (doc_id, error): failures are left out, unless fewer than `least` remain."""
    x = items.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return x.withColumn("error", F.when(F.col("good") < least, "none could be processed"))


def decoded_pages(pages: DataFrame, encoded: str = "data") -> DataFrame:
    """`content` from base64, with or without what stands before a first comma; `error` names the page that isn't valid."""
    body = F.regexp_replace(encoded, r"\A[^,]*,", "")
    out = pages.withColumn("content", F.try_to_binary(body, F.lit("base64")))
    return out.withColumn("error", F.when(F.col("content").isNull(), concat("page ", F.col("page_no").cast("string"), " is not valid base64")))


def pages_json(pages: DataFrame) -> DataFrame:
    """(doc_id, body): a document's pages (page_no, width, height, content) as one JSON object, in order."""
    row = F.struct(F.col("page_no").alias("_n"), F.struct((F.col("page_no") - 1).alias("index"), "width", "height", F.base64("content").alias("data")).alias("x"))
    x = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_p"))
    return x.select("doc_id", F.to_json(F.struct(F.transform("_p", lambda p: p["x"]).alias("pages"), F.size("_p").alias("total"))).alias("body"))
