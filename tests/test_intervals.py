import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import intervals as V
from pageloom.operators import pages as P


def plain(pages, edits):
    """Lists of (page, rotation), edited one by one."""
    pages = list(pages)
    for op, at, to in edits:
        other = at + (to or 0) if op == "swap" else to
        if not 0 <= at < len(pages) or (op in ("move", "swap") and not 0 <= other < len(pages)):
            continue
        if op == "remove":
            del pages[at]
        elif op == "rotate":
            pages[at] = (pages[at][0], (pages[at][1] + to) % 360)
        elif op == "duplicate":
            pages.insert(at, pages[at])
        else:
            pages.insert(other, pages.pop(at))
    return pages


def some_edits(rnd, n, reach):
    out = []
    for _ in range(n):
        op = rnd.choice(["remove", "rotate", "duplicate", "move", "swap"])
        to = {"rotate": rnd.choice([90, 180, -90, 450]), "move": rnd.randrange(-1, reach), "swap": rnd.choice([-1, 1])}.get(op)
        out.append((op, rnd.randrange(-1, reach), to))
    return out


@pytest.mark.parametrize("group", [2, 256])
def test_a_thousand_edits_of_a_document_in_one_plan(spark, monkeypatch, group):
    rnd = random.Random(group)
    sizes = {0: 500, 1: 3, 2: 9000, 3: 1, 4: 20}
    edits = {d: some_edits(rnd, 1000 if d in (0, 2) else 30 * (d < 4), n + 2) for d, n in sizes.items()}
    pages = spark.createDataFrame([(d, p, p * 90 % 360, f"{d}/{p}") for d, n in sizes.items() for p in range(1, n + 1)], "doc_id long, page_no int, rotation int, what string")
    rows = [(d, i, *e) for d, es in edits.items() for i, e in enumerate(es)] + [(77, 0, "remove", 0, None), (None, 0, "remove", 0, None), (1, None, "remove", 0, None)]
    rnd.shuffle(rows)
    got = V.edited(pages, spark.createDataFrame(rows, "doc_id long, seq long, op string, at long, to long")).collect()
    for d, n in sizes.items():
        want = plain([(p, p * 90 % 360) for p in range(1, n + 1)], edits[d])
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.page_no)
        assert [r.page_no for r in mine] == [*range(1, len(want) + 1)] and [(r.what, r.rotation) for r in mine] == [(f"{d}/{p}", t) for p, t in want]


@pytest.mark.parametrize("group", [2, 5, 256])
def test_pieces_against_a_list(monkeypatch, group):
    monkeypatch.setattr(V.Pieces, "GROUP", group)
    rnd = random.Random(group)
    for total in (0, 1, 2, 40):
        edits, now = some_edits(rnd, 600, total + 5), V.Pieces(total)
        for e in edits:
            now.apply(*e)
        rows = list(now.rows())
        assert [(p, t) for lo, hi, _, t in rows for p in range(lo, hi + 1)] == plain([(p, 0) for p in range(1, total + 1)], edits)
        assert [b for *_, b, _ in rows] == [sum(hi - lo + 1 for lo, hi, *_ in rows[:i]) for i in range(len(rows))]


def test_no_edits_and_no_pages(spark):
    pages = spark.createDataFrame([(1, 1, 90), (1, 2, None)], "doc_id long, page_no int, rotation int")
    none = spark.createDataFrame([], "doc_id long, seq long, op string, at long, to long")
    assert sorted(map(tuple, V.edited(pages, none).collect())) == [(1, 1, 90), (1, 2, 0)]
    assert V.edited(pages.where("false"), none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_sets(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, [(a, a + rnd.randrange(5)) for a in (rnd.randrange(1, 30) for _ in range(rnd.randrange(8)))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, runs array<struct<lo:bigint,hi:bigint>>")
    for r in df.select("id", V.merged(F.col("runs")).alias("m"), V.with_places(F.col("runs")).alias("w"), V.run_length(F.col("runs")).alias("n")).collect():
        runs = rows[r.id][1]
        flat = [p for lo, hi in runs for p in range(lo, hi + 1)]
        assert [p for x in r.m for p in range(x.lo, x.hi + 1)] == sorted(set(flat)) and r.n == len(flat)
        assert all(b.lo > a.hi + 1 for a, b in zip(r.m, r.m[1:], strict=False)) and [x.before for x in r.w] == [sum(b - a + 1 for a, b in runs[:i]) for i in range(len(runs))]


def test_a_request_for_many_pages_has_few_rows(spark):
    """The request's side of the join has a row for each 4096 pages, and one document's pages are many groups."""
    n = 3_000_000
    pages = spark.range(1, n + 1, numPartitions=8).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    out = P.extract_combined(pages, spark.createDataFrame([(1, f"1-{n},5,2-{n}")], "doc_id long, spec string"))
    got = out.agg(F.count("*"), F.max("out_page"), F.sum(F.col("out_page").cast("long"))).first()
    assert tuple(got) == (2 * n, 2 * n, n * (2 * n + 1))
    runs = P.requested(pages.where("page_no <= 10"), spark.createDataFrame([(1, "1-9,3")], "doc_id long, spec string")).first()
    assert [tuple(r) for r in runs.runs] == [(1, 9), (3, 3)]
    huge = spark.createDataFrame([(1, 1, 10**8, 0)], "doc_id long, lo long, hi long, before long")
    few = spark.createDataFrame([(1, 1), (1, 5000), (1, 10**8)], "doc_id long, page_no int")
    assert sorted(r.out_page for r in V.placed(few, huge).collect()) == [1, 5000, 10**8]
