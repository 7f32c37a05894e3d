import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from pageloom.operators import annotate, history, media
from pageloom.operators import pages as P
from pageloom.sources import codecs, files


def doc(spark, *counts):
    return spark.createDataFrame([(d, p, 0) for d, n in enumerate(counts) for p in range(1, n + 1)], "doc_id long, page_no int, rotation int")


def test_extract_of_unknown_document_is_an_error_row(spark):
    r = P.extract_combined(doc(spark, 3), spark.createDataFrame([(7, "1")], "doc_id long, spec string")).collect()
    assert [x["error"] for x in r] == ["no such document"]


def test_extract_of_no_pages(spark):
    assert P.extract_combined(doc(spark), spark.createDataFrame([], "doc_id long, spec string")).count() == 0


def test_organize_duplicates_and_rotates(spark):
    c = spark.createDataFrame([(0, '[{"page": 2, "rotation": -90}, {"page": 2}]')], "doc_id long, config string")
    got = P.organize(doc(spark, 2), c).orderBy("out_page").collect()
    assert [(r["page_no"], r["rotation"]) for r in got] == [(2, 270), (2, 0)]


def test_merge_names_the_missing_input(spark):
    inputs = spark.createDataFrame([(1, 0, 0), (1, 1, 9)], "output_id long, input_no int, doc_id long")
    assert "no such document: 9" in P.merge(doc(spark, 2), inputs).first()["error"]


def test_undo_redo_against_a_list(spark):
    import random

    rng, rows = random.Random(1), []
    for page in range(4):
        for seq in range(300):
            a = rng.choice(["commit", "commit", "undo", "redo", "delete"])
            rows.append((page, seq, a, f"[{rng.randint(0, 3)}]" if a in ("commit", "delete") else None))
    got = {(r["page_id"], r["seq"]): (r["snapshot"], r["depth"]) for r in history.undo_redo(spark.createDataFrame(rows, "page_id long, seq long, action string, snapshot string"), keep=7).collect()}
    for page in range(4):
        past, cursor = ["[]"], 0
        for p, seq, a, s in rows:
            if p != page:
                continue
            if a == "undo":
                cursor -= cursor > 0
            elif a == "redo":
                cursor += cursor < len(past) - 1
            elif a == "delete" or past[cursor] != s:
                past = past[: cursor + 1] + [s]
                if len(past) > 7:
                    past.pop(0)
                cursor = len(past) - 1
            assert got[page, seq] == (past[cursor], len(past))


def test_compression_keeps_a_document_that_grows(spark):
    rows = [("d", 1, 0, "x", 5, 5, "RGB", 100, 120), ("d", 2, 0, "x", 5, 5, "RGB", 100, 10)]
    got = media.compression(spark.createDataFrame(rows, "doc_id string, page_no int, ordinal int, xref string, width int, height int, mode string, bytes_len long, new_len long")).first()
    assert (got["size_before"], got["size_after"], got["reduction_percent"], got["kept_original"]) == (100, 100, 0.0, True)


def test_archive_round_trip(spark):
    e = spark.createDataFrame([("a.zip", 2, "p2", b"two"), ("a.zip", 1, "p1", b"one")], "archive string, entry_no int, entry_name string, content binary")
    z = zipfile.ZipFile(io.BytesIO(bytes(files.archives(e).first()["content"])))
    assert z.namelist() == ["p1", "p2"] and z.read("p2") == b"two"


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    x = files.uploads(spark, str(tmp_path), "*.pdf")
    assert [(r["filename"], r["file_size_bytes"]) for r in x.collect()] == [("a.pdf", 5)]
    assert tuple(files.folder_usage(files.uploads(spark, str(tmp_path))).first()) == (2, 6)


def test_decoding_without_a_codec_is_an_error_row(spark):
    x = codecs.decode_documents(spark.createDataFrame([("d", b"%PDF")], "doc_id string, content binary"), "pdf")
    assert x.first()["error"] == "no codec for pdf"


def test_progress_events_skip_other_lines(spark):
    lines = spark.createDataFrame([('data: {"type": "progress", "page": 1, "total": 2}',), ("",), (": note",)], "value string")
    assert [(r["type"], r["page"]) for r in files.progress_events(lines).collect()] == [("progress", 1)]


def test_erase_ignores_strokes_without_points(spark):
    o = spark.createDataFrame([(1, 1, "pen", [], None, None, None, None, None, None), (1, 2, "rect", None, 0.0, 0.0, 5.0, 5.0, None, None)], "page_id int, object_id int, type string, points array<double>, x double, y double, width double, height double, text string, font_size double")
    s = spark.createDataFrame([(1, 14.0, 3.0)], "page_id int, px double, py double")
    assert [r["object_id"] for r in annotate.erase(o, s).collect()] == [1]


def test_erase_on_a_crowded_page_against_brute_force(spark):
    rng, inf, nan = random.Random(5), float("inf"), float("nan")
    size = lambda: rng.choice([0.0, 3.0, 50.0, 4000.0, 1e300, -15.0, -500.0])
    rows = [(1 if i % 3 else i % 5, i, "rect" if i % 4 else "text", None, rng.uniform(-5000, 5000), rng.uniform(-5000, 5000), size(), size(), "t", size()) for i in range(300)]
    rows += [(1, 300, "rect", None, -inf, 0.0, inf, 5.0, None, None), (1, 301, "rect", None, nan, 0.0, 5.0, 5.0, None, None), (None, 302, "rect", None, 0.0, 0.0, 1e9, 1e9, None, None), (1, 303, "rect", None, 0.0, None, 5.0, 5.0, None, None)]
    rows += [rows[0], rows[1]]
    o = spark.createDataFrame(rows, "page_id int, object_id int, type string, points array<double>, x double, y double, width double, height double, text string, font_size double")
    points = [(1 if i % 3 else i % 5, rng.uniform(-5000, 5000), rng.uniform(-5000, 5000)) for i in range(60)] + [(1, inf, 2.0), (1, nan, 2.0), (1, 10.0, 10.0), (None, 0.0, 0.0), (1, None, 0.0)]
    s = spark.createDataFrame(points, "page_id int, px double, py double")
    boxes = annotate.bounding_box(o).alias("o")
    p = s.select(F.col("page_id").alias("_page"), "px", "py")
    hit = (F.col("page_id") == F.col("_page")) & F.expr("px between x1 - 10 and x2 + 10 and py between y1 - 10 and y2 + 10")
    want = sorted(r[0] for r in boxes.join(p, hit, "left_anti").select("object_id").collect())
    got = annotate.erase(o, s)
    assert got.columns == o.columns and sorted(r["object_id"] for r in got.collect()) == want and 20 < len(want) < 280
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?:SortMergeJoin|HashJoin) \[(.*?)\]", plan)
    assert keys and all("," in k for k in keys)  # a page alone is never the key


def test_history_log_of_garbage_is_empty(spark):
    assert spark.range(1).select(files.history_log(F.lit("nope")).alias("x")).first()["x"] == []


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1), ("a.pdf", 2), ("b", 1)], "output_name string, page_no int")
    files.write_pages(pages, f"{tmp_path}/over")
    files.write_pages(pages.where("page_no = 1"), f"{tmp_path}/over")
    assert spark.read.parquet(f"{tmp_path}/over").count() == 2
    for run in ("r1", "r2"):
        files.write_new(pages, f"{tmp_path}/new", run)
    assert spark.read.parquet(f"{tmp_path}/new").count() == 6 and len([x for x in (tmp_path / "new").iterdir() if "output_name=" in x.name]) == 4


def test_debounced_stream_matches_batch(spark, tmp_path):
    """A late event in a second file moves the watermark past every burst of the first."""
    from pageloom.streaming.state import debounced

    rows = [(k, f"2024-01-01 00:{m:02d}:{s:02d}", m * 60 + s) for k in (1, 2) for m in (0, 5, 9) for s in (1, 2, 30 + k)]
    first = spark.createDataFrame(rows, "key long, ts string, value long").withColumn("ts", F.to_timestamp("ts"))
    first.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    last = spark.createDataFrame([(9, "2024-06-01 00:00:00", 0)], "key long, ts string, value long").withColumn("ts", F.to_timestamp("ts"))
    last.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = debounced(stream, gap="10 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, debounced(first, gap="10 seconds").collect())) and len(got) == 12
