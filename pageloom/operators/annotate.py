"""Edits of annotation objects: rows (page_id, object_id, type, x, y, width, height, points, text, font_size, ...).

type is pen, highlighter, line, rect, circle or text; points are x and y in turn. A text without width grows with what
is typed, so its null width means something. Every edit is a projection; no object is seen with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import font_size

TOLERANCE = 10.0
# How strokes are drawn.
HIGHLIGHTER_WIDTH, HIGHLIGHTER_OPACITY = 12, 0.4


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))


def scaled(points: Column, sx: Column, sy: Column, x: Column, y: Column) -> Column:
    return F.transform(points, lambda v, i: F.when(i % 2 == 0, v * sx + x).otherwise(v * sy + y))


def _axis(points: Column, k: int) -> Column:
    return F.filter(points, lambda v, i: i % 2 == k)


def created(presses: DataFrame) -> DataFrame:
    """presses (page_id, object_id, type, px, py, stroke_width) with the x, y, width, height, points and opacity that a new object starts with."""
    kind, box = F.col("type"), F.col("type").isin("rect", "circle")
    points = F.when(kind.isin("pen", "highlighter"), F.array("px", "py")).when(kind == "line", F.array("px", "py", "px", "py"))
    return presses.withColumns(
        {
            "x": F.when(box, F.col("px")).otherwise(0.0),
            "y": F.when(box, F.col("py")).otherwise(0.0),
            "width": F.when(box, 0.0),
            "height": F.when(box, 0.0),
            "points": points,
            "stroke_width": F.when(kind == "highlighter", HIGHLIGHTER_WIDTH).otherwise(F.col("stroke_width")).cast("int"),
            "opacity": F.when(kind == "highlighter", HIGHLIGHTER_OPACITY).when(kind == "pen", 1.0),
        }
    )


def bounding_box(objects: DataFrame) -> DataFrame:
    """objects with x1, y1, x2, y2; null for a stroke without points. A text without width is taken as 0.6 of its font size a letter."""
    xs, ys = _axis(F.col("points"), 0), _axis(F.col("points"), 1)
    drawn, line, text = F.col("type").isin("pen", "highlighter"), F.col("type") == "line", F.col("type") == "text"
    lx, ly = F.slice(xs, 1, 2), F.slice(ys, 1, 2)
    far_x = F.col("x") + F.when(text, F.coalesce(F.nullif("width", F.lit(0.0)), F.length("text") * F.col("font_size") * 0.6)).otherwise(F.col("width"))
    far_y = F.col("y") + F.when(text, F.col("font_size")).otherwise(F.col("height"))
    pick = lambda stroke, two, box: F.when(drawn, stroke).when(line, two).otherwise(box)
    return objects.withColumns(
        {
            "x1": pick(F.array_min(xs), F.array_min(lx), F.when(text, F.col("x")).otherwise(F.least("x", far_x))),
            "y1": pick(F.array_min(ys), F.array_min(ly), F.when(text, F.col("y")).otherwise(F.least("y", far_y))),
            "x2": pick(F.array_max(xs), F.array_max(lx), F.when(text, far_x).otherwise(F.greatest("x", far_x))),
            "y2": pick(F.array_max(ys), F.array_max(ly), F.when(text, far_y).otherwise(F.greatest("y", far_y))),
        }
    )


def erase(objects: DataFrame, strokes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """objects without those that an eraser point of strokes (page_id, px, py) touches: a range join on the page and grid cells.

    A box goes to a grid whose cells, a power of two wide, are no smaller than itself, so that it lies in four of them at
    most; a point goes to its cell in each grid that has boxes. Boxes without finite bounds meet all points of the page.
    """
    corners = ["x1", "y1", "x2", "y2"]
    o = bounding_box(objects)
    low, high = (lambda v: F.col(v) - tolerance), (lambda v: F.col(v) + tolerance)
    some = (low("x1") <= high("x2")) & (low("y1") <= high("y2"))
    boxes = o.where(F.col("page_id").isNotNull() & some).select("page_id", *corners).distinct()
    span = F.greatest(high("x2") - low("x1"), high("y2") - low("y1"))
    boxes = boxes.withColumn("_grid", F.when(span < float("inf"), F.greatest(F.lit(0), F.ceil(F.log2(span)).cast("int"))).otherwise(-1))
    cell = lambda v: F.when(F.col("_grid") >= 0, F.floor(v.cast("double") / F.pow(F.lit(2.0), "_grid"))).otherwise(0)
    for axis in ("x", "y"):
        boxes = boxes.withColumn(f"_{axis}", F.explode(F.sequence(cell(low(f"{axis}1")), cell(high(f"{axis}2")))))
    points = strokes.select(F.col("page_id").alias("_page"), "px", "py").distinct().crossJoin(F.broadcast(boxes.select("_grid").distinct()))
    points = points.select("_page", "px", "py", F.col("_grid").alias("_pg"), cell(F.col("px")).alias("_px"), cell(F.col("py")).alias("_py"))
    same = (F.col("page_id") == F.col("_page")) & (F.col("_grid") == F.col("_pg")) & (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py"))
    inside = F.col("px").between(low("x1"), high("x2")) & F.col("py").between(low("y1"), high("y2"))
    hit = boxes.join(points, same & inside, "left_semi").select("page_id", *corners).distinct()
    return o.join(hit, ["page_id", *corners], "left_anti").select(*[c for c in objects.columns if c not in corners])


def _only(types: tuple[str, ...], new: Column, old: str) -> Column:
    return F.when(F.col("type").isin(*types), new).otherwise(F.col(old))


def dragged(objects: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Strokes and lines by their points, the rest by x and y."""
    moved = ("rect", "circle", "text")
    out = {"points": _only(("pen", "highlighter", "line"), shifted(F.col("points"), dx, dy), "points"), "x": _only(moved, F.col("x") + dx, "x"), "y": _only(moved, F.col("y") + dy, "y")}
    return objects.withColumns(out)


def circle_moved(x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct(x, y): the corner of a circle whose centre is at x, y."""
    return F.struct((x - width / 2).alias("x"), (y - height / 2).alias("y"))


def resized(objects: DataFrame, sx: Column, sy: Column, x: Column, y: Column) -> DataFrame:
    """After a transformation: strokes and lines by their points; rectangles and circles to at least 5 by 5; texts by resized_text."""
    boxes = ("rect", "circle")
    points = _only(("pen", "highlighter", "line"), scaled(F.col("points"), sx, sy, x, y), "points")
    size, width = resized_text(F.col("font_size"), F.col("width"), sx, sy)
    out = {
        "points": points,
        "width": F.when(F.col("type") == "text", width).otherwise(_only(boxes, F.greatest(F.lit(5.0), F.col("width") * sx), "width")),
        "height": _only(boxes, F.greatest(F.lit(5.0), F.col("height") * sy), "height"),
        "font_size": _only(("text",), size, "font_size"),
        "x": _only((*boxes, "text"), x, "x"),
        "y": _only((*boxes, "text"), y, "y"),
    }
    return objects.withColumns(out)


def resized_text(size: Column, width: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    """(font size, width) of a text after a transformation by sx, sy.

    A text without width takes the larger factor. One with width grows wider, to at least 20, if only sx changed, and
    else takes sy for its letters; changes up to 0.01 are none.
    """
    across, down = F.abs(sx - 1) > 0.01, F.abs(sy - 1) > 0.01
    new_size = F.when(width.isNull(), font_size(size * F.greatest(sx, sy))).when(down, font_size(size * sy)).otherwise(size)
    new_width = F.when(width.isNotNull() & across & ~down, F.greatest(F.lit(20.0), width * sx)).otherwise(width)
    return new_size, new_width


def box_allowed(width: Column, height: Column) -> Column:
    """Whether a transformation may leave a box of this size."""
    return (F.abs(width) >= 20) & (F.abs(height) >= 20)


def text_kind(drag_x: Column, drag_y: Column) -> Column:
    """A text begun by a drag of more than 10 is an area, else it starts at a point."""
    return F.when((F.abs(drag_x) > 10) | (F.abs(drag_y) > 10), "area").otherwise("point")


def committed(objects: DataFrame) -> DataFrame:
    """Texts whose content is blank go; all else stays."""
    return objects.where((F.col("type") != "text") | (F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") != ""))


def drawn(strokes: DataFrame) -> DataFrame:
    """(page_id, object_id, type, points): strokes grown point by point from samples (page_id, object_id, type, seq, px, py).

    Pens and highlighters keep every point in order; lines the first and the last.
    """
    sample, line = F.struct("seq", "px", "py"), F.col("type").eqNullSafe("line")
    free = F.collect_list(F.when(~line, sample))  # a line's samples are never gathered
    ends = [f(F.when(line, sample)).alias(c) for f, c in ((F.min, "_from"), (F.max, "_to"))]
    x = strokes.groupBy("page_id", "object_id", "type").agg(free.alias("_s"), *ends, F.count("*").alias("_n"))
    two = F.when(F.col("_n") > 1, F.array("_from", "_to")).otherwise(F.array("_from"))
    x = x.withColumn("_s", F.when(line, two).otherwise(F.array_sort("_s")))
    return x.select("page_id", "object_id", "type", F.flatten(F.transform("_s", lambda p: F.array(p["px"], p["py"]))).alias("points"))


def patched(objects: DataFrame, patches: DataFrame) -> DataFrame:
    """objects with the last patch (page_id, object_id, seq, field, value) of each field that was changed: x, y, width, height, font_size."""
    fields = ("x", "y", "width", "height", "font_size")
    last = patches.where(F.col("field").isin(*fields)).groupBy("page_id", "object_id").pivot("field", list(fields)).agg(F.max_by("value", "seq"))
    last = last.select("page_id", "object_id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = objects.join(last, ["page_id", "object_id"], "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def exported(pages: DataFrame) -> DataFrame:
    """A page's picture is its stage, three times as large, or the page as it was if it has never been shown."""
    return pages.withColumn("scale", F.when(F.col("stage").isNotNull(), 3).otherwise(1)).withColumn("content", F.coalesce("stage", "content")).drop("stage")
