from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pageloom.operators.history import append_history
from pageloom.sources import store
from pageloom.streaming.newest import merge_newest


def rows(spark, writer, n=6):
    return spark.range(n).select(F.col("id").alias("page_no"), F.lit(writer).alias("writer")).repartition(3)


def test_overwriting_one_name_leaves_others(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert store.read(spark, path) is None and store.versions(spark, path, "a") == []
    names = ["a.pdf", "007", "q=1/2 %41{x}*", "日本 é.pdf", "_hidden", ".dot"]
    for name in names:
        assert store.put(rows(spark, "first"), path, name) == 1
    assert store.put(rows(spark, "second", 2), path, "a.pdf") == 2
    got = {(r.output_name, r.version): (r.writer, r["n"]) for r in store.read(spark, path).groupBy("output_name", "version", "writer").agg(F.count("*").alias("n")).collect()}
    assert got == {(x, 1 + (x == "a.pdf")): ("second", 2) if x == "a.pdf" else ("first", 6) for x in names}
    assert {r.writer for r in store.read(spark, path, "a.pdf", below=2).collect()} == {"first"}
    assert store.forget(spark, path, "a.pdf") == 1 and store.versions(spark, path, "a.pdf") == [2] and store.read(spark, path, "a.pdf").count() == 2
    assert store.forget(spark, path, "a.pdf") == 0


def test_writers_at_once_never_mix_or_lose_pages(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.put(rows(spark, "other"), path, "other")
    with ThreadPoolExecutor(6) as pool:
        got = sorted(pool.map(lambda i: store.put(rows(spark, f"w{i}", 5 + i), path, "a"), range(6)))
    assert got == [1, 2, 3, 4, 5, 6]
    whole = [store.read(spark, path, "a", below=v + 1).groupBy("writer").count().collect() for v in got]
    assert all(len(x) == 1 and x[0]["count"] == 5 + int(x[0].writer[1:]) for x in whole) and len({x[0].writer for x in whole}) == 6
    assert store.read(spark, path, "other").count() == 6


def test_one_of_writers_at_once_gets_the_name(spark, tmp_path):
    path = f"{tmp_path}/s"
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda i: store.put_new(rows(spark, f"w{i}"), path, "a.pdf", f"r{i}"), range(4)))
    assert len(set(names)) == 4 and names.count("a.pdf") == 1 and all(x.startswith("a") and x.endswith(".pdf") for x in names)
    got = {r.output_name: (r.writer, r["n"]) for r in store.read(spark, path).groupBy("output_name", "writer").agg(F.count("*").alias("n")).collect()}
    assert got == {x: (f"w{i}", 6) for i, x in enumerate(names)}
    assert store.put_unique(rows(spark, "again"), path, "a.pdf", "r9") == store.put_unique(rows(spark, "twice"), path, "a.pdf", "r9")
    assert {r.writer for r in store.read(spark, path).where("writer in ('again', 'twice')").collect()} == {"again"}
    assert not [x for x in (tmp_path / "s").iterdir() if x.name.startswith("_staged")]


def test_a_lost_job_leaves_nothing_that_is_read(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.put(rows(spark, "first"), path, "a")
    with pytest.raises(Exception, match="lost"):
        store.put(rows(spark, "bad").withColumn("x", F.raise_error(F.lit("lost")).cast("string")), path, "a")
    assert store.versions(spark, path, "a") == [1] and {r.writer for r in store.read(spark, path).collect()} == {"first"}


def test_moves_of_other_file_systems(spark, tmp_path, monkeypatch):
    """As on HDFS: by Hadoop's own rename, which refuses a place that is taken."""
    real = store._place

    class Other:
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "other"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(store, "_place", lambda spark, path: (Other(real(spark, path)[0]), real(spark, path)[1]))
    assert store.put(rows(spark, "x"), f"{tmp_path}/s", "a", version=3) == 3
    monkeypatch.setattr(store, "versions", lambda *_: [])  # as for a writer that looked before
    assert store.put(rows(spark, "y"), f"{tmp_path}/s", "a", version=3) is None
    assert {r.writer for r in store.read(spark, f"{tmp_path}/s").collect()} == {"x"}


@pytest.mark.parametrize("key", [None, "user"])
def test_kept_history_equals_the_batch_and_survives_replays(spark, tmp_path, key):
    log = spark.range(200).select(F.col("id"), (F.col("id") * 37 % 50).alias("ts"), (F.col("id") * F.col("id") % 3).alias("user"))
    batches = [log.where(f"id % 4 = {i}") for i in range(4)]
    path, want = f"{tmp_path}/h", lambda upto: sorted(map(tuple, append_history(log.where(f"id % 4 < {upto}"), log.limit(0), key, 7).collect()))
    merge = merge_newest(path, key=key, keep=7)
    now = lambda: sorted(map(tuple, store.read(spark, path, "history").drop("output_name", "version").collect()))
    for i, b in enumerate(batches):
        merge(b, i)
        assert now() == want(i + 1)
        merge(b, i)  # again, as after a failure
        if i:
            merge(batches[i - 1], i - 1)
        assert now() == want(i + 1)
    assert len(store.versions(spark, path, "history")) == 2


def test_kept_history_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 20, i * 20 + 30).select("id", (F.col("id") % 11).alias("ts"), (F.col("id") % 4).alias("user")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = spark.read.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(merge_newest(f"{tmp_path}/h", key="user", keep=3)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, store.read(spark, f"{tmp_path}/h").select(*log.columns).collect()))
    assert got == sorted(map(tuple, append_history(log.limit(0), log, "user", 3).collect())) and len(got) == 12
