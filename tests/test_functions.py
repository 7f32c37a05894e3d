import math

import pytest
from pyspark.sql import functions as F

from pageloom.functions import codes as C
from pageloom.functions import geometry as G
from pageloom.functions import naming as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, ext, want",
    [
        ("Hasil Merge", "pdf", "Hasil_Merge.pdf"),
        ("report.pdf", "pdf", "report.pdf"),
        ("my:file/name?*", "pdf", "my_file_name.pdf"),
        ("", "pdf", "output.pdf"),
        ("   ", "pdf", "output.pdf"),
        (None, "pdf", "output.pdf"),
        ("Test", "PDF", "Test.pdf"),
        ("compressed_output.pdf", "pdf", "compressed_output.pdf"),
        ("dokumen_saya", "pdf", "dokumen_saya.pdf"),
        ("extracted_pages", "zip", "extracted_pages.zip"),
        ("file___name", "pdf", "file_name.pdf"),
    ],
)
def test_sanitize_filename(spark, name, ext, want):
    assert one(spark, N.sanitize_filename(F.lit(name).cast("string"), ext)) == want


@pytest.mark.parametrize("name, want", [("v1.25", "v1"), ("a.pdf", "a"), ("x.toolong", "x.toolong"), ("..", "output"), ("My Document", "My_Document")])
def test_sanitize_stem(spark, name, want):
    assert one(spark, N.sanitize_stem(F.lit(name))) == want


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048576, "1.00 MB"), (5000000000, "4768.37 MB")])
def test_format_bytes(spark, n, want):
    assert one(spark, N.format_bytes(F.lit(n))) == want


def test_colours_and_messages(spark):
    assert one(spark, N.hex_to_rgba(F.lit("#ff8000"), F.lit(40))) == "rgba(255, 128, 0, 0.4)"
    assert one(spark, N.hex_to_rgba(F.lit(""), F.lit(40))) == "transparent"
    assert one(spark, N.error_message(F.lit('{"detail": "d"}'), F.lit("x"))) == "d"
    assert one(spark, N.error_message(F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, N.titled_name(F.lit(" "), F.lit("a.pdf.pdf"))) == "a.pdf"
    assert one(spark, N.field_name(F.lit(" a/b  c "), 4)) == "a_b_"
    assert one(spark, N.output_name(F.lit("r.pdf"), F.lit(1))).startswith("r_")


def test_letterbox(spark):
    b = one(spark, G.letterbox(F.lit(100), F.lit(50), F.lit(595.0), F.lit(842.0)))
    assert b["scale"] == 5.95 and math.isclose(b["y0"], (842 - 297.5) / 2)
    assert one(spark, G.letterbox(F.lit(0), F.lit(50), F.lit(595.0), F.lit(842.0)))["scale"] == 1.0


@pytest.mark.parametrize("dpi, quality, want", [(72, "auto", 72), (300, "low", 93), (300, "auto", 186), (300, "high", 300), (72, "low", 72), (1, "auto", 36)])
def test_preview_dpi(spark, dpi, quality, want):
    assert one(spark, G.preview_dpi(F.lit(612.0), F.lit(792.0), F.lit(quality), F.lit(dpi))) == want


@pytest.mark.parametrize("kind, n, ok", [("ean13", k, k in (12, 13)) for k in range(6, 15)] + [("ean8", k, k in (7, 8)) for k in range(6, 15)])
def test_ean_lengths(spark, kind, n, ok):
    assert (one(spark, C.barcode_error(F.lit("1" * n), F.lit(kind), F.lit("svg"))) is None) == ok


def test_codes(spark):
    assert one(spark, C.permission_mask(F.lit(False), F.lit(False), F.lit(None).cast("boolean"))) == 512
    assert one(spark, C.qr_error(F.lit("x"), F.lit(21), F.lit(0), F.lit("PNG"))) == "size is not 1 to 20"
    assert one(spark, C.removal_error(F.lit(False))) == "not protected"
    assert one(spark, C.protection_error(F.lit(True), F.lit("p"))) == "already protected"
    assert one(spark, C.with_status(F.lit("bad")))["detail"] == "bad"
