"""Three grammars of page ranges, kept apart because they differ on empty, backward, outside and malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, concat, strip

_HUGE = (1 << 62) - 1
_SHAPE = r"^[0-9]+(-[0-9]+)?$"


def _number(digits: Column) -> Column:
    """A run of digits as a long; one too long for that is beyond every document."""
    return F.coalesce(digits.try_cast("long"), F.lit(_HUGE))


def _first(t: Column) -> Column:
    return _number(F.regexp_extract(t, r"^([0-9]+)", 1))


def _last(t: Column) -> Column:
    return _number(F.regexp_extract(t, r"([0-9]+)$", 1))


def tokens(spec: Column) -> Column:
    """The parts between commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ",", -1), strip), lambda t: t != "")


def _first_error(errors: Column) -> Column:
    return F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))


def page_runs(spec: Column, total: Column) -> Column:
    """struct(runs array<struct<lo, hi>>, error string): a run of page numbers, from 1, for each part of spec.

    Blank input is an error, so are parts that are neither `n` nor `n-m`, that leave 1..total or that run backwards; the
    first bad part in order is named, and a part outside the document is that before it is backward. Commas alone give no runs.
    """
    total = total.cast("long")

    def error(t: Column) -> Column:
        return (
            F.when(~t.rlike(_SHAPE), concat("'", t, "' is not a page or a range"))
            .when((_first(t) < 1) | (_last(t) > total), concat("'", t, "' is outside pages 1-", total.cast("string")))
            .when(_first(t) > _last(t), concat("'", t, "' runs backwards"))
        )

    found = F.when(blank(spec), F.lit("no pages given")).otherwise(_first_error(F.transform(tokens(spec), error)))
    runs = F.transform(tokens(spec), lambda t: F.struct(_first(t).alias("lo"), _last(t).alias("hi")))
    return F.struct(F.when(found.isNull(), runs).alias("runs"), found.alias("error"))


def page_groups(spec: Column, total: Column) -> Column:
    """struct(groups array<array<int>>, error string): as page_runs, with every page of each part; for short requests."""
    runs = page_runs(spec, total)
    return F.struct(F.transform(runs["runs"], lambda r: F.sequence(r["lo"], r["hi"]).cast("array<int>")).alias("groups"), runs["error"].alias("error"))


def rule_pages(spec: Column, total: Column, inside: bool = True) -> Column:
    """struct(pages array<int>, error string): page numbers of a rule, flat and in the order asked for.

    Blank input is all pages; `5-3` is 5, 4, 3; repeats stay; a malformed part is an error. With `inside`, so is a page
    outside 1..total; without, runs are taken as they are, as far as integers go.
    """
    total = total.cast("long")
    every = F.when(total >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(total, F.lit(1)))).otherwise(F.array().cast("array<long>"))

    def error(t: Column) -> Column:
        out = F.when(~t.rlike(_SHAPE), concat("'", t, "' is not a page or a range"))
        if inside:
            out = out.when((F.least(_first(t), _last(t)) < 1) | (F.greatest(_first(t), _last(t)) > total), concat("'", t, "' is outside pages 1-", total.cast("string")))
        return out.when(F.greatest(_first(t), _last(t)) > 2147483647, concat("'", t, "' is too large"))

    found = F.when(blank(spec), F.lit(None).cast("string")).otherwise(_first_error(F.transform(tokens(spec), error)))
    most = F.lit(2147483647).cast("long")
    asked = F.flatten(F.transform(tokens(spec), lambda t: F.when(found.isNull(), F.sequence(F.least(_first(t), most), F.least(_last(t), most))).otherwise(F.array().cast("array<long>"))))
    return F.struct(F.when(found.isNull(), F.when(blank(spec), every).otherwise(asked)).cast("array<int>").alias("pages"), found.alias("error"))


def shown_pages(spec: Column, total: Column) -> Column:
    """array<int>: the pages that a selection field highlights, ascending and without repeats.

    Blank input is all pages. Nothing is an error: numbers are read as far as they go (`5abc` is 5, `1-2-3` is 1-2),
    ranges are clamped to the document, backward ranges and single pages outside it are ignored.
    """
    total = total.cast("long")
    lead = lambda x: F.regexp_extract(x, r"(?U)^\s*([0-9]+)", 1)
    none = F.array().cast("array<long>")

    def run(t: Column) -> Column:
        a, b = F.split_part(t, F.lit("-"), F.lit(1)), F.split_part(t, F.lit("-"), F.lit(2))
        ranged, known = t.contains("-"), (lead(a) != "") & (lead(b) != "")
        lo, hi = F.greatest(_number(lead(a)), F.lit(1)), F.least(_number(lead(b)), total)
        one = _number(lead(t))
        return (
            F.when(ranged & known & (_number(lead(a)) <= _number(lead(b))) & (lo <= hi), F.sequence(lo, F.greatest(lo, hi)))
            .when(~ranged & (lead(t) != "") & (one >= 1) & (one <= total), F.array(one))
            .otherwise(none)
        )

    every = F.when(total >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(total, F.lit(1)))).otherwise(none)
    asked = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(spec, F.lit("")), ",", -1), lambda t: run(strip(t))))))
    return F.when(blank(spec), every).otherwise(asked).cast("array<int>")


def is_shown(page: Column, spec: Column, total: Column) -> Column:
    return F.array_contains(shown_pages(spec, total), page.cast("int"))
