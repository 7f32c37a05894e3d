"""Sources and sinks: uploads as binary files, JSON arrays as columns, archives, logs and event streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import unique_name
from ..schema import HISTORY, PAGE_CONFIG, PROGRESS, RULE


def uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, filename, file_size_bytes, modified, path, content) of every file below; content is read only if it is used."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return x.select(F.sha2("path", 256).alias("doc_id"), name.alias("filename"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified"), "path", "content")


def folder_usage(files: DataFrame) -> DataFrame:
    """(files, bytes) of uploads."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"))


def document_info(pages: DataFrame, size: Column) -> DataFrame:
    """(doc_id, total_pages, file_size_bytes)."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"), F.sum(size).cast("long").alias("file_size_bytes"))


def rules_from_json(requests: DataFrame, body: str = "rules") -> DataFrame:
    """A row for each rule of a JSON array, with input_no; a body that isn't one gives an error row."""
    x = requests.withColumn("_r", F.from_json(body, T.ArrayType(RULE)))
    bad = F.col("_r").isNull() | ~F.col(body).rlike(r"^\s*\[")
    good = x.where(~bad).select(*[c for c in requests.columns if c != body], F.posexplode("_r").alias("input_no", "_x"))
    good = good.select("*", "_x.*").drop("_x").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(x.where(bad).select(*[c for c in requests.columns if c != body], F.lit("not a list of rules").alias("error")), allowMissingColumns=True)


def page_config(body: Column) -> Column:
    """struct(pages, error) of a JSON list of page and rotation; missing numbers are page 1 and rotation 0."""
    x = F.from_json(body, PAGE_CONFIG)
    pages = F.transform(x, lambda c: F.struct(F.coalesce(c["page"], F.lit(1)).alias("page"), F.coalesce(c["rotation"], F.lit(0)).alias("rotation")))
    ok = x.isNotNull() & body.rlike(r"^\s*\[")
    return F.struct(F.when(ok, pages).alias("pages"), F.when(~F.coalesce(ok, F.lit(False)), "not a list of pages").alias("error"))


def side_array(body: Column, element: str = "int") -> Column:
    """A JSON array beside the main one; anything else is an empty one."""
    x = F.from_json(body, f"array<{element}>")
    return F.when(body.rlike(r"^\s*\["), F.coalesce(x, F.array().cast(f"array<{element}>"))).otherwise(F.array().cast(f"array<{element}>"))


def by_ordinal(values: Column, i: Column, default) -> Column:
    """The value at index i from 0; a missing one is the default."""
    return F.coalesce(F.when((i >= 0) & (i < F.size(values)), F.get(values, i.cast("int"))), F.lit(default))


def history_log(body: Column) -> Column:
    """array of entries, empty if the body can't be read."""
    return F.coalesce(F.from_json(body, T.ArrayType(HISTORY)), F.array().cast(T.ArrayType(HISTORY)))


def progress_events(lines: DataFrame) -> DataFrame:
    """Events of a text source's `value` lines: those that begin with `data: `, as columns."""
    x = lines.where(F.col("value").startswith("data: ")).select(F.from_json(F.substring("value", F.lit(7), F.length("value")), PROGRESS).alias("e"))
    return x.select("e.*").where("type is not null")


def archives(entries: DataFrame) -> DataFrame:
    """(archive, content, entries): a ZIP file for each archive of entries (archive, entry_no, entry_name, content).

    An archive is made in one task, since a ZIP file is one stream; what goes into one has to fit a task.
    """

    def zipped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values(["entry_no", "entry_name"]).itertuples():
                z.writestr(zipfile.ZipInfo(r.entry_name, (1980, 1, 1, 0, 0, 0)), r.content)
        return pd.DataFrame({"archive": [key[0]], "content": [out.getvalue()], "entries": [len(pdf)]})

    return entries.select("archive", "entry_no", "entry_name", F.col("content").cast("binary").alias("content")).groupBy("archive").applyInPandas(zipped, "archive string, content binary, entries int")


def write_pages(pages: DataFrame, path: str) -> None:
    """Overwrites a whole table of pages; store.put overwrites what one name has."""
    pages.write.mode("overwrite").parquet(path)


def write_new(pages: DataFrame, path: str, run: str) -> None:
    """Appends a table of pages under a name of its own, which the run's id makes."""
    pages.withColumn("output_name", unique_name(F.col("output_name"), F.lit(run))).write.mode("append").partitionBy("output_name").parquet(path)
