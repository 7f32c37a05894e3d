"""Tables of pages kept by name: a name has versions, a version appears whole or not at all, and the newest one counts.

A writer puts its rows into a folder of its own and then moves that folder to the version's place, which succeeds only if
nothing is there. So writers of one name never mix or lose rows, other names are left alone, and what a lost job has left
behind is never read. The move is one step on local and mounted folders and on HDFS; a store that moves folders
file by file doesn't give that.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import unique_name


def _place(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop has them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def _names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = _place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder with files to a place where nothing is, in one step; False, and nothing done, if something is there."""
    fs, to = _place(spark, target)
    fs.mkdirs(to.getParent())
    if fs.getScheme() == "file":
        try:
            os.rename(urlparse(source).path, urlparse(target).path)  # fails on a folder that isn't empty
            return True
        except OSError:
            if not fs.exists(to):
                raise
            return False
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(_place(spark, source)[1], to, how)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False


def _folder(path: str, name: str) -> str:
    """As partitions are named: any character of ASCII that a path could take for its own is a percent code."""
    return f"{path}/output_name=" + "".join(c if c.isalnum() or c in " ._-()" or ord(c) > 127 else f"%{ord(c):02X}" for c in name)


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    return sorted(int(x.removeprefix("version=")) for x in _names_in(spark, _folder(path, name)) if x.startswith("version="))


def _versions_to_try(spark: SparkSession, path: str, name: str) -> Iterator[int]:
    last = 0
    while True:
        last = max([last, *versions(spark, path, name)]) + 1
        yield last


def put(pages: DataFrame, path: str, name: str, version: int | None = None) -> int | None:
    """Overwrites what the name has, by a new version whose number is returned. Of writers at the same time, the one that is done last counts.

    version: then it is put as that one if it isn't there yet, and None is returned if it is: a repeated call changes nothing.
    A column output_name or version of pages isn't kept.
    """
    spark = pages.sparkSession
    if version is not None and version in versions(spark, path, name):
        return None
    path = _place(spark, path)[1].toString()
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    pages.drop("output_name", "version").write.parquet(staged)
    for v in _versions_to_try(spark, path, name) if version is None else [version]:
        if _moved(spark, staged, f"{_folder(path, name)}/version={v}"):
            return v
    _delete(spark, staged)
    return None


def put_unique(pages: DataFrame, path: str, name: str, run: str) -> str:
    """Puts pages under a name of their own, which the run's id makes and which is returned; a repeated call changes nothing."""
    own = pages.sparkSession.range(1).select(unique_name(F.lit(name), F.lit(run))).first()[0]
    put(pages, path, own, version=1)
    return own


def put_new(pages: DataFrame, path: str, name: str, run: str) -> str:
    """Puts pages under the name if nothing is there, else as put_unique does; returns the name."""
    if not versions(pages.sparkSession, path, name) and put(pages, path, name, version=1):
        return name
    return put_unique(pages, path, name, run)


def read(spark: SparkSession, path: str, name: str | None = None, below: int | None = None) -> DataFrame | None:
    """The pages of a name or of all names, with output_name and version: of each the newest version, or the newest below a number. None if there are none.

    All names have the columns of the first.
    """
    path = _place(spark, path)[1].toString()
    folders = [_folder(path, name)] if name is not None else [f"{path}/{x}" for x in _names_in(spark, path) if x.startswith("output_name=")]
    newest = []
    for folder in folders:
        there = [int(x.removeprefix("version=")) for x in _names_in(spark, folder) if x.startswith("version=")]
        there = [v for v in there if below is None or v < below]
        if there:
            newest.append(f"{folder}/version={max(there)}")
    if not newest:
        return None
    schema = T.StructType([*spark.read.parquet(newest[0]).schema.fields, T.StructField("output_name", T.StringType()), T.StructField("version", T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(*newest)


def forget(spark: SparkSession, path: str, name: str, keep: int = 1) -> int:
    """Deletes all versions of a name but the newest `keep`; returns how many went. Who still reads one of these fails."""
    old = versions(spark, path, name)[: -keep or None]
    for v in old:
        _delete(spark, f"{_folder(path, name)}/version={v}")
    return len(old)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)
