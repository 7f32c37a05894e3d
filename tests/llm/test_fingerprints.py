"""Sketches against sets, and the query against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pageloom.llm import fingerprints as fp


def key(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)


def pairs(seed):
    rnd = random.Random(seed)
    out = [([], []), ([1], []), ([], [1]), ([1, 2], [1, 2])]
    for size in (1, 5, 20, 100, 700, 3000):
        both = [rnd.randrange(1 << 40) for _ in range(size)]
        for change in {0, 1, 3, size // 2, size}:
            out.append((both, both[: size - change] + [rnd.randrange(1 << 40) for _ in range(rnd.randrange(change + 1))]))
            out.append((both[: size - change], both))
    return out


def test_differences_of_all_sizes_are_recovered(spark):
    rows = [(i, [key(x) for x in a], [key(x) for x in b]) for i, (a, b) in enumerate(pairs(1))]
    df = spark.createDataFrame(rows, "id long, a array<long>, b array<long>").repartition(4)
    df = fp.with_differences(df, ["id"], {"diff": ("a", "b"), "back": ("b", "a")})
    df = df.withColumn("larger", fp._larger(F.col("a"), F.col("b"), fp._side(F.col("a"), F.col("b")))).withColumn("near", fp.likeness(F.col("a"), F.col("diff")))
    for r in df.collect():
        a, b = set(rows[r.id][1]), set(rows[r.id][2])
        want = sorted([(x, 1) for x in a - b] + [(x, -1) for x in b - a])
        assert sorted((x.k, x.n) for x in r["diff"]) == sorted((x.k, -x.n) for x in r["back"]) == sorted((x.k, x.n) for x in r["larger"]) == want
        assert r.near == (len(a & b) / len(a | b) if a | b else 1.0)


@pytest.mark.parametrize("turns", [0, 1])
def test_pairs_that_fail_are_tried_again(spark, monkeypatch, turns):
    monkeypatch.setattr(fp, "_TURNS", turns)
    test_differences_of_all_sizes_are_recovered(spark)


def test_a_written_fingerprint_reads_back(spark):
    docs = spark.createDataFrame([(1, "A b.\nC d.\nE"), (2, "A b.\nC d.\nF"), (3, None), (4, "")], "id int, text string")
    got = docs.select("id", fp.fingerprint(F.col("text")).alias("f"), fp.sketch(fp.digests(F.col("text")), F.lit(fp.SIZE)).alias("cells")).withColumn("back", fp.read(F.col("f"))).collect()
    by = {r.id: r for r in got}
    assert all(r.cells == r.back for r in got) and by[3].f == by[4].f != by[1].f and by[1].f.startswith("3:")
    gone = spark.createDataFrame([(by[1].f, by[2].f)], "a string, b string").select(fp.peeled(fp.subtracted(fp.read(F.col("a")), fp.read(F.col("b"))), F.lit(fp.SIZE)).alias("x")).first().x
    digest = lambda p: int(hashlib.md5(p.encode()).hexdigest()[:15], 16)
    assert gone.ok and sorted((x.n, x.k) for x in gone.found) == [(-1, digest("F")), (1, digest("E"))]


def test_paragraphs(spark):
    text = "One. Two!\n\n" + "x" * 210 + "\nOne. Two!\n" + "Ü😀" * 60
    got = spark.createDataFrame([(text,)], "text string").select(fp.paragraphs(F.col("text"))).first()[0]
    assert got == ["One. Two!", "x" * 100, "x" * 10, "Ü😀" * 50, "Ü😀" * 10]


ROWS = [(5, "a.\nb.\nc.\nd."), (3, "a.\nb.\nx."), (3, "a.\nb.\nx."), (3, "a.\nb.\nx."), (3, "other"), (9, None), (None, "no id.\nat all."), (1, ""), (4, "É😀" * 900), (-2, "a.\nb.\nc.\nd.")]


def test_rows_follow_each_other(spark):
    names = ["own", "next", "times", "k1", "v", "near_next"]
    docs = spark.createDataFrame([(*r, *["z"] * len(names)) for r in ROWS], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(5)
    got = fp.fingerprinted(docs).collect()
    assert sorted(map(str, [r.doc_id for r in got])) == sorted(str(d) for d, _ in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    edit = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    assert by[5][0].edited_sha256 == sha(edit("a.\nb.\nc.\nd.", "É😀" * 900)) and by[9][0].edited_sha256 == sha("")
    assert by[None][0].edited_sha256 == sha(edit("no id.\nat all.", "")) and by[-2][0].edited_sha256 == sha(edit("a.\nb.\nc.\nd.", "no id.\nat all."))
    assert by[5][0].fingerprint == by[-2][0].fingerprint and by[9][0].near_next == 0.0 and by[1][0].near_next == 0.0
    assert sum(r.near_next == 1.0 for r in by[3]) == 2 and len(by[3]) == 4
    assert by[4][0].n_chars == 1800


@pytest.mark.parametrize("rows", [[], [(1, "one.\nonly.")], [(1, "x.\ny.")] * 4])
def test_few_rows(spark, rows):
    got = fp.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.near_next == 1.0 for r in got)
    assert all(r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest() for r, (_, t) in zip(got, rows, strict=True))
