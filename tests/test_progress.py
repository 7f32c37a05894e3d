import random
from datetime import datetime, timedelta

import pytest

from pageloom.queries.streams import drained
from pageloom.streaming import progress as R

SCHEMA = "request long, seq long, ts timestamp, kind string, page int, total int, message string"
AT = datetime(2024, 1, 1)
SILENCE = timedelta(minutes=10)


def work(seed):
    rnd, rows, seq = random.Random(seed), [], 0
    for request in range(30):
        at, total = AT + timedelta(minutes=rnd.randrange(60)), rnd.randrange(1, 5)
        for _ in range(rnd.randrange(1, 12)):
            at += timedelta(seconds=rnd.choice([0, 5, 60, 599, 600, 601, 1500]))
            seq += 1
            kind = "failed" if rnd.random() < 0.1 else "page"
            rows.append((request, seq, at, kind, rnd.choice([None, *range(1, total + 1)]) if kind == "page" else None, total, f"m{seq}"))
    return rows


def plain(rows):
    """One request after another, in a loop."""
    out = []
    for request in sorted({r[0] for r in rows}):
        last, seen = None, set()
        for _, _, at, kind, page, total, message in sorted((r for r in rows if r[0] == request), key=lambda r: (r[2], r[1])):
            if last and at - last > SILENCE:
                out.append((request, "error", None, None, "no news", last + SILENCE))
                break
            if kind == "failed":
                out.append((request, "error", None, None, message, at))
                break
            last = at
            if page is not None and page not in seen:
                seen.add(page)
                out.append((request, "progress", page, round(len(seen) / total * 100, 1), None, at))
                if len(seen) == total:
                    out.append((request, "complete", None, 100.0, None, at))
                    break
        else:
            out.append((request, "error", None, None, "no news", last + SILENCE))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.request, r.type, r.page, r.percent, r.message, r.ts) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_batch_against_a_loop(spark, seed):
    rows = work(seed)
    assert told(R.batch_progress(spark.createDataFrame([*rows, (None, 0, AT, "page", 1, 1, "")], SCHEMA), SILENCE)) == plain(rows)


def stream(spark, at, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return told(drained(R.request_progress(source, SILENCE, late="30 minutes")))


def test_a_stream_of_many_batches_ends_each_request_once(spark, tmp_path):
    rows = sorted(work(5), key=lambda r: r[2])
    far = (99, 10**6, AT + timedelta(days=2), "page", 1, 9, "")
    cut = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    got = stream(spark, tmp_path, [*cut, [far], [(98, 10**6 + 1, AT + timedelta(days=2), "failed", None, 1, "end")]])
    got = [r for r in got if r[0] < 98]
    assert got == plain(rows)
    ends = [r[0] for r in got if r[1] != "progress"]
    assert len(ends) == len(set(ends)) == 30


def test_late_and_repeated_rows_tell_nothing_new(spark, tmp_path):
    page = lambda seq, minute, p, total=2: (1, seq, AT + timedelta(minutes=minute), "page", p, total, "")
    got = stream(spark, tmp_path, [[page(1, 0, 1), page(2, 0, 1)], [page(1, 0, 1), page(3, 5, 2)], [page(4, 6, 1), page(3, 5, 2)], [(1, 9, AT + timedelta(minutes=7), "failed", None, 2, "late")]])
    assert [r[1:4] for r in got] == [("complete", None, 100.0), ("progress", 1, 50.0), ("progress", 2, 100.0)]


def test_silence_is_told_by_the_watermark(spark, tmp_path):
    rows = [(1, 1, AT, "page", 1, 5, "")]
    later = [(2, 2, AT + timedelta(hours=3), "page", 1, 5, "")]
    after = [(1, 3, AT + timedelta(hours=3), "page", 2, 5, "")]
    got = stream(spark, tmp_path, [rows, later, after])
    assert [r for r in got if r[0] == 1] == [(1, "error", None, None, "no news", AT + SILENCE), (1, "progress", 1, 20.0, None, AT)]
