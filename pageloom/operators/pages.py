"""The algebra of page sequences. A document is rows (doc_id, page_no from 1, ...); order is the column page_no.

Results carry their order in `out_page` or `page_no`. A document that a request can't be applied to gives one row with
`error` instead of pages. No operator numbers rows over a whole table: positions come from arrays of the request, or
from sums over a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.naming import sanitize_stem
from ..functions.ranges import page_runs
from ..functions.text import concat
from ..schema import PAGE_CONFIG
from .intervals import merged, placed, run_length, with_places


def page_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages)."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))


def merge(pages: DataFrame, inputs: DataFrame) -> DataFrame:
    """Documents one after another: inputs (output_id, input_no, doc_id) to pages with output_id and out_page added.

    An output of fewer than two inputs, or with one that has no pages, is an error row. Where a page lands is a sum of
    page counts, over the list of inputs alone.
    """
    listed = inputs.join(page_counts(pages), "doc_id", "left")
    w = W.partitionBy("output_id")
    before = w.orderBy("input_no").rowsBetween(W.unboundedPreceding, -1)
    missing = F.min(F.when(F.col("total_pages").isNull(), F.struct("input_no", "doc_id"))).over(w)
    error = F.when(F.count("*").over(w) < 2, F.lit("fewer than two inputs")).when(missing.isNotNull(), concat("no such document: ", missing["doc_id"].cast("string")))
    listed = listed.withColumn("error", error).withColumn("_before", F.coalesce(F.sum("total_pages").over(before), F.lit(0)))
    good = pages.join(listed.where("error is null").select("output_id", "input_no", "doc_id", "_before"), "doc_id")
    good = good.withColumn("out_page", (F.col("_before") + F.col("page_no")).cast("int")).drop("_before").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(listed.where("error is not null").select("output_id", "error").distinct(), allowMissingColumns=True)


def requested(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (doc_id, spec) with total_pages, runs and error: a run of pages for each part, however many pages it has."""
    known = requests.join(page_counts(pages), "doc_id", "left")
    parsed = known.withColumn("_p", page_runs(F.col("spec"), F.coalesce("total_pages", F.lit(0))))
    return parsed.withColumn("runs", F.col("_p.runs")).withColumn("error", F.when(F.col("total_pages").isNull(), "no such document").otherwise(F.col("_p.error"))).drop("_p")


def _with_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (doc_id, run, ..., error) with the run's pages and out_page; an error is a row without pages. Requests without either leave nothing."""
    good = placed(pages, runs.where("error is null and run is not null").select("*", "run.*").drop("run", "error")).withColumn("error", F.lit(None).cast("string"))
    bad = runs.where("error is not null").select("doc_id", "error").select("*")
    return good.unionByName(bad, allowMissingColumns=True)


def _gathered(pages: DataFrame, picks: DataFrame) -> DataFrame:
    """picks (doc_id, page_no, ..., error) with their pages; a row with an error has none. Requests without pages or an error leave nothing."""
    return picks.where("page_no is not null or error is not null").join(pages, ["doc_id", "page_no"], "left")


def _place(i: str) -> Column:
    return (F.col(i) + 1).cast("int")


def extract_combined(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """All pages asked for as one output, in the order and as often as asked: pages with out_page and error added."""
    return _with_pages(pages, requested(pages, requests).select("doc_id", F.explode_outer(with_places(F.col("runs"))).alias("run"), "error"))


def extract_pages(pages: DataFrame, requests: DataFrame, stem: Column) -> DataFrame:
    """A file for each different page asked for, ascending: pages with entry_no, entry_name and error added. stem: of the requests."""
    r = requested(pages, requests).withColumn("_stem", sanitize_stem(stem))
    out = _with_pages(pages, r.select("doc_id", "_stem", F.explode_outer(with_places(merged(F.col("runs")))).alias("run"), "error"))
    name = F.when(F.col("page_no").isNotNull(), F.format_string("%s_page%04d.pdf", "_stem", "page_no"))
    return out.withColumn("entry_name", name).withColumnRenamed("out_page", "entry_no").drop("_stem")


def extract_ranges(pages: DataFrame, requests: DataFrame, stem: Column) -> DataFrame:
    """A file for each part of the request, with the part's pages in out_page order; parts that repeat share a name and differ in entry_no."""
    r = requested(pages, requests).withColumn("_stem", sanitize_stem(stem))
    r = r.select("doc_id", "_stem", F.posexplode_outer("runs").alias("_g", "_r"), "error")
    lo, hi = F.col("_r.lo").cast("string"), F.col("_r.hi").cast("string")
    name = concat(F.col("_stem"), "_page", F.when(lo == hi, lo).otherwise(concat(lo, "-", hi)), ".pdf")
    run = F.when(F.col("_r").isNotNull(), F.struct("_r.lo", "_r.hi", F.lit(0).cast("long").alias("before")))
    return _with_pages(pages, r.select("doc_id", _place("_g").alias("entry_no"), name.alias("entry_name"), run.alias("run"), "error"))


def split_all(pages: DataFrame, stem: Column) -> DataFrame:
    """A file for every page; stem: of pages."""
    name = concat(sanitize_stem(stem), "_page", F.col("page_no").cast("string"), ".pdf")
    return pages.withColumn("entry_no", F.col("page_no")).withColumn("entry_name", name).withColumn("out_page", F.lit(1))


def pages_extracted(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, pages_extracted, files, error): pages counted as often as they are asked for, files without repeats."""
    r = requested(pages, requests)
    return r.select("doc_id", run_length(F.col("runs")).cast("int").alias("pages_extracted"), run_length(merged(F.col("runs"))).cast("int").alias("files"), "error")


def organize(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """Pages gathered by configs (doc_id, config: JSON list of page and rotation): out_page and error added, rotation summed.

    A page that a config names twice is two pages. A missing page number is 1, a missing rotation 0. A config that isn't
    a list, is empty or names a page that isn't there makes its document an error row.
    """
    known = configs.join(page_counts(pages), "doc_id", "left")
    known = known.withColumn("_c", F.from_json("config", PAGE_CONFIG))
    chosen = F.transform("_c", lambda c: F.struct(F.coalesce(c["page"], F.lit(1)).alias("page"), F.coalesce(c["rotation"], F.lit(0)).alias("rotation")))
    outside = F.try_element_at(F.filter(chosen, lambda c: (c["page"] < 1) | (c["page"] > F.col("total_pages"))), F.lit(1))
    error = (
        F.when(F.col("total_pages").isNull(), F.lit("no such document"))
        .when(F.col("_c").isNull() | ~F.col("config").rlike(r"^\s*\["), F.lit("not a list of pages"))
        .when(F.size("_c") == 0, F.lit("no pages left"))
        .when(outside.isNotNull(), concat("no page ", outside["page"].cast("string")))
    )
    picks = known.select("doc_id", F.posexplode_outer(F.when(error.isNull(), chosen)).alias("_i", "c"), error.alias("error"))
    picks = picks.select("doc_id", F.col("c.page").alias("page_no"), F.col("c.rotation").alias("_turn"), _place("_i").alias("out_page"), "error")
    out = _gathered(pages, picks)
    return out.withColumn("rotation", F.pmod(F.coalesce("rotation", F.lit(0)) + F.coalesce("_turn", F.lit(0)), F.lit(360))).drop("_turn")


def select_for_rendering(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """The different pages asked for, ascending; a blank request means all, one that leaves none is an error."""
    totals = requests.join(page_counts(pages), "doc_id", "left")
    every = concat("1-", F.col("total_pages").cast("string"))
    r = requested(pages, totals.select("doc_id", F.when(F.trim(F.coalesce("spec", F.lit(""))) == "", every).otherwise(F.col("spec")).alias("spec")))
    chosen = merged(F.col("runs"))
    r = r.select("doc_id", F.explode_outer(with_places(chosen)).alias("run"), F.coalesce("error", F.when(F.size(chosen) == 0, F.lit("no pages selected"))).alias("error"))
    return _with_pages(pages, r)


# Edits of a list of pages at an index from 0. `at` and the like are columns of pages, the same all over a document.


def remove_at(pages: DataFrame, at: Column) -> DataFrame:
    """Without the page at the index; an index outside changes nothing."""
    hit = F.col("page_no") == at + 1
    inside = (at >= 0) & (F.col("page_no") > at + 1)
    return pages.where(~hit).withColumn("page_no", F.when(inside, F.col("page_no") - 1).otherwise(F.col("page_no")).cast("int"))


def rotate_at(pages: DataFrame, at: Column, degrees: int = 90) -> DataFrame:
    return pages.withColumn("rotation", F.when(F.col("page_no") == at + 1, F.pmod(F.col("rotation") + degrees, F.lit(360))).otherwise(F.col("rotation")).cast("int"))


def duplicate_at(pages: DataFrame, at: Column) -> DataFrame:
    """With a copy right after the page at the index."""
    shift = F.when((at >= 0) & (F.col("page_no") > at + 1), 1).otherwise(0)
    copies = F.when(F.col("page_no") == at + 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(shift))
    out = pages.withColumn("_copy", F.explode(copies))
    return out.withColumn("page_no", (F.col("page_no") + F.col("_copy")).cast("int")).drop("_copy")


def move(pages: DataFrame, old: Column, new: Column) -> DataFrame:
    """The page at index old put at index new; those between close up."""
    i = F.col("page_no") - 1
    to = F.when(i == old, new).when((old < new) & (i > old) & (i <= new), i - 1).when((old > new) & (i >= new) & (i < old), i + 1).otherwise(i)
    return pages.withColumn("page_no", (to + 1).cast("int"))


def swap_neighbour(pages: DataFrame, at: Column, step: int) -> DataFrame:
    """The page at the index exchanged with the one before (step -1) or after it (1); at an end nothing happens."""
    total = F.max("page_no").over(W.partitionBy("doc_id"))
    i, other = F.col("page_no") - 1, at + step
    able = (at >= 0) & (at < total) & (other >= 0) & (other < total)
    to = F.when(able & (i == at), other).when(able & (i == other), at).otherwise(i)
    return pages.withColumn("page_no", (to + 1).cast("int"))


def toggle_page(selected: Column, page: Column, total: Column) -> Column:
    """The text of a selection after a click on a page: the page taken out or put in; all pages, or none, read as blank."""
    s = F.when(F.array_contains(selected, page), F.array_remove(selected, page)).otherwise(F.array_append(selected, page))
    text = F.array_join(F.transform(F.array_sort(F.array_distinct(s)), lambda p: p.cast("string")), ", ")
    return F.when(F.size(F.array_distinct(s)) == total, "").otherwise(text)


def needs_reset(ids: Column, first: Column) -> Column:
    """Whether the order of pages differs from the first one; rotations don't matter."""
    return ~F.array_join(ids.cast(T.ArrayType(T.StringType())), ",").eqNullSafe(F.array_join(first.cast(T.ArrayType(T.StringType())), ","))
