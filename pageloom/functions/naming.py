"""File names, sizes and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, concat, strip

_ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'


def _clean(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, _ILLEGAL, "_"), r"(?U)[\s_]+", "_")
    x = F.btrim(x, F.lit("._- "))
    return F.when(x == "", "output").otherwise(x)


def sanitize_filename(name: Column, extension: str = "pdf") -> Column:
    """A safe name with the extension, which is taken off first where the name has it in any case."""
    ext = extension.lower().lstrip(".")
    x = F.coalesce(name, F.lit(""))
    stem = F.when(F.lower(x).endswith(f".{ext}"), F.substring(x, F.lit(1), F.length(x) - len(ext) - 1)).otherwise(x)
    return concat(_clean(stem), f".{ext}")


def sanitize_stem(name: Column) -> Column:
    """A safe name without its last `.xx` to `.xxxxx`."""
    return _clean(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[a-zA-Z0-9]{2,5}\z", ""))


def unique_name(name: Column, salt: Column) -> Column:
    """name with `_` and 8 hex digits before its extension. The digits are a hash of the salt, so reruns agree."""
    digits = F.substring(F.sha2(salt.cast("string"), 256), 1, 8)
    return concat(F.regexp_replace(name, r"\.[^.]*\z", ""), "_", digits, F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def output_name(name: Column, salt: Column, extension: str = "pdf") -> Column:
    """The composition that always-unique outputs use: stem, then file name, then 8 hex digits."""
    return unique_name(sanitize_filename(sanitize_stem(name), extension), salt)


def titled_name(title: Column, original: Column) -> Column:
    """The file name after a change of properties: the title, or the original without `.pdf`, made safe."""
    return sanitize_filename(F.when(blank(title), F.replace(F.coalesce(original, F.lit("")), F.lit(".pdf"), F.lit(""))).otherwise(title))


def unlocked_name(name: Column) -> Column:
    return sanitize_filename(concat(sanitize_stem(name), "_unlocked"))


def is_pdf_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def header_filename(disposition: Column, output_header: Column, fallback: Column) -> Column:
    """The quoted file name of a Content-Disposition, else the other header, else the fallback; empty counts as missing."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(disposition, F.lit("")), 'filename="([^"]+)"', 1), F.lit("")), F.nullif(output_header, F.lit("")), fallback)


def format_bytes(n: Column) -> Column:
    """Bytes, KB with one decimal or MB with two, halves away from zero."""
    n = n.cast("long")
    kb, mb = (F.format_string(f, n / F.lit(d)) for f, d in (("%.1f KB", 1024.0), ("%.2f MB", 1048576.0)))
    return F.when(n < 1024, concat(n.cast("string"), " B")).when(n < 1048576, kb).otherwise(mb)


def hex_to_rgba(color: Column, opacity: Column) -> Column:
    """`#rrggbb` and an opacity in per cent as `rgba(r, g, b, a)`; rgba and transparent pass through, blank is transparent."""
    part = lambda k: F.conv(F.substring(color, k, 2), 16, 10)
    alpha = opacity.cast("double") / 100
    alpha = F.when(alpha == F.floor(alpha), F.floor(alpha).cast("string")).otherwise(alpha.cast("string"))
    mixed = concat("rgba(", part(2), ", ", part(4), ", ", part(6), ", ", alpha, ")")
    return F.when(F.coalesce(color, F.lit("")) == "", "transparent").when(color.startswith("rgba") | (color == "transparent"), color).otherwise(mixed)


def font_style(bold: Column, italic: Column) -> Column:
    words = F.concat_ws(" ", F.when(italic, "italic"), F.when(bold, "bold"))
    return F.when(words == "", "normal").otherwise(words)


def field_name(x: Column, longest: int | None = None) -> Column:
    """What a file name field leaves of its text: illegal characters and runs of white space as `_`, cut at `longest`."""
    x = F.regexp_replace(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r'[<>:"/\\|?*]', "_"), r"(?U)\s+", "_")
    return F.left(x, F.lit(longest)) if longest else x


def error_message(body: Column, default: Column) -> Column:
    """The message of an error body in JSON, else its detail, else the default; empty counts as missing."""
    found = [F.nullif(F.get_json_object(body, p), F.lit("")) for p in ("$.message", "$.detail")]
    return F.coalesce(*found, default)
