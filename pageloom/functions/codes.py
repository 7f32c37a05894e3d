"""What is checked before a code is drawn, permissions, and properties of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, concat, strip

SYMBOLOGIES = ("code128", "ean13", "ean8", "code39")
# Permission bits of the PDF format.
PRINT, MODIFY, COPY, ANNOTATE, FORM, ACCESSIBILITY, ASSEMBLE, PRINT_HQ = 4, 8, 16, 32, 256, 512, 1024, 2048


def qr_error(content: Column, size: Column, border: Column, image_format: Column) -> Column:
    """What is wrong with a request for a QR code; null if nothing is."""
    return (
        F.when(blank(content), "content is empty")
        .when(~size.between(1, 20), "size is not 1 to 20")
        .when(border < 0, "border is negative")
        .when(~F.lower(image_format).isin("png", "svg"), "unknown format")
    )


def qr_correction(level: Column) -> Column:
    """L, M, Q or H; anything else is M."""
    level = F.upper(F.coalesce(level, F.lit("")))
    return F.when(level.isin("L", "M", "Q", "H"), level).otherwise("M")


def barcode_error(content: Column, symbology: Column, image_format: Column) -> Column:
    """What is wrong with a request for a barcode. EAN-13 takes 12 or 13 digits and EAN-8 7 or 8, white space at the ends aside; digits are 0-9."""
    kind, text = F.lower(symbology), strip(F.coalesce(content, F.lit("")))
    return (
        F.when(blank(content), "content is empty")
        .when(~kind.isin(*SYMBOLOGIES), "unknown symbology")
        .when(~F.lower(image_format).isin("png", "svg"), "unknown format")
        .when((kind == "ean13") & ~text.rlike(r"\A[0-9]{12,13}\z"), "EAN-13 takes 12 or 13 digits")
        .when((kind == "ean8") & ~text.rlike(r"\A[0-9]{7,8}\z"), "EAN-8 takes 7 or 8 digits")
    )


def permission_mask(may_print: Column, may_copy: Column, may_modify: Column) -> Column:
    """The permission bits: access for readers always, the groups as allowed."""
    group = lambda on, bits: F.when(F.coalesce(on, F.lit(False)), bits).otherwise(0)
    mask = F.lit(ACCESSIBILITY)
    for on, bits in ((may_print, PRINT | PRINT_HQ), (may_copy, COPY), (may_modify, MODIFY | ANNOTATE | ASSEMBLE | FORM)):
        mask = mask.bitwiseOR(group(on, bits))
    return mask


def metadata_overlay(metadata: Column, title: Column, author: Column, subject: Column, keywords: Column) -> Column:
    """A map of properties with four of them overwritten; one that isn't given becomes blank."""
    new = {"title": title, "author": author, "subject": subject, "keywords": keywords}
    kept = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*new))
    return F.map_concat(kept, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]))


def protection_error(encrypted: Column, user_password: Column) -> Column:
    return F.when(blank(user_password), "a password is needed").when(encrypted, "already protected")


def removal_error(encrypted: Column) -> Column:
    return F.when(~encrypted, "not protected")


def with_status(error: Column, status: int = 422) -> Column:
    """The envelope of a result: struct(status, message, detail)."""
    ok = error.isNull()
    return F.struct(F.when(ok, "success").otherwise("error").alias("status"), F.when(ok, "ok").otherwise(concat("failed with ", str(status))).alias("message"), error.alias("detail"))
