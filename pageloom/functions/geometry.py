"""Page and image geometry, in points and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page sizes in points.
PAGE_SIZES = {"a4": (595, 842), "a3": (842, 1191), "letter": (612, 792), "legal": (612, 1008)}
# The longest side of a preview in pixels.
PREVIEW_PIXELS = {"low": 1024, "auto": 2048, "high": 4096}


def page_size(name: Column, width: Column, height: Column) -> Column:
    """struct(w, h) of a page size by name; `match_image` is the image's own, a pixel for a point."""
    w, h = width, height
    for k, (a, b) in PAGE_SIZES.items():
        w, h = F.when(F.lower(name) == k, F.lit(float(a))).otherwise(w), F.when(F.lower(name) == k, F.lit(float(b))).otherwise(h)
    return F.struct(w.cast("double").alias("w"), h.cast("double").alias("h"))


def letterbox(width: Column, height: Column, page_w: Column, page_h: Column) -> Column:
    """struct(scale, x0, y0, x1, y1): an image as large as fits on a page, centred; one without area is not scaled."""
    w, h = width.cast("double"), height.cast("double")
    scale = F.when((w > 0) & (h > 0), F.least(page_w / F.nullif(w, F.lit(0.0)), page_h / F.nullif(h, F.lit(0.0)))).otherwise(1.0)
    x, y = (page_w - w * scale) / 2, (page_h - h * scale) / 2
    return F.struct(scale.alias("scale"), x.alias("x0"), y.alias("y0"), (x + w * scale).alias("x1"), (y + h * scale).alias("y1"))


def preview_dpi(width: Column, height: Column, quality: Column, dpi: Column) -> Column:
    """The resolution, at least 36, at which no side of a page is longer than its preview may be."""
    most = F.lit(PREVIEW_PIXELS["auto"])
    for k, v in PREVIEW_PIXELS.items():
        most = F.when(quality == k, F.lit(v)).otherwise(most)
    w, h = width * dpi / F.lit(72.0), height * dpi / F.lit(72.0)
    scaled = F.when((w > most) | (h > most), dpi * F.least(most / w, most / h)).otherwise(dpi.cast("double"))
    return F.greatest(F.lit(36), scaled.cast("int"))


def clockwise(rotation: Column) -> Column:
    """Degrees counterclockwise that turn an image clockwise by rotation; none is none."""
    r = F.pmod(rotation, F.lit(360))
    return F.when(r == 0, 0).otherwise(360 - r)


def turned(width: Column, height: Column, rotation: Column) -> Column:
    """struct(w, h) after a rotation by quarter turns."""
    aside = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(aside, height).otherwise(width).alias("w"), F.when(aside, width).otherwise(height).alias("h"))


def upright(width: Column, height: Column, orientation: Column) -> Column:
    """struct(w, h, mirrored, rotation): the size of a picture once its EXIF orientation is undone, and how: mirrored first, then turned clockwise."""
    o = F.when(orientation.between(2, 8), orientation).otherwise(1)
    aside = o >= 5
    rotation = F.when(o.isin(3, 4), 180).when(o.isin(6, 7), 90).when(o.isin(5, 8), 270).otherwise(0)
    return F.struct(F.when(aside, height).otherwise(width).alias("w"), F.when(aside, width).otherwise(height).alias("h"), o.isin(2, 4, 5, 7).alias("mirrored"), rotation.alias("rotation"))


def rotate_step(rotation: Column, degrees: int) -> Column:
    return F.pmod(rotation + degrees, F.lit(360))


def zoom(value: Column, step: Column, most: float = 3.0) -> Column:
    """A zoom factor a few steps of a quarter further, from 0.25 to `most`."""
    return F.least(F.lit(most), F.greatest(F.lit(0.25), value + step * F.lit(0.25)))


def base_scale(width: Column, factor: Column) -> Column:
    """Screen pixels for a page unit: 800 across the page at a factor of 1."""
    return F.lit(800.0) / width * factor


def scroll_after_zoom(scroll: Column, view: Column, old: Column, new: Column) -> Column:
    """The scroll position that keeps the middle of the view where it was."""
    return (scroll + view / 2) / old * new - view / 2


def quality_label(quality: Column) -> Column:
    return F.when(quality >= 85, "high").when(quality >= 65, "good").when(quality >= 40, "medium").otherwise("low")


def splash_progress(ms: Column) -> Column:
    """Per cent shown after so many ms of waiting: nears 90."""
    return F.least(F.lit(90), F.floor(F.lit(90.0) * (1 - F.exp(-ms / F.lit(5000.0))) + 0.5)).cast("int")


def font_size(size: Column) -> Column:
    """To one decimal, halves up, and at least 1."""
    return F.greatest(F.lit(1.0), F.floor(size * 10 + 0.5) / 10)
