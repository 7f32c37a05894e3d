"""Periodic runs against a brute-force search, and the query's own fixtures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_documents import ODD, word_list

from pageloom.llm import runs
from pageloom.llm.queries import QUERIES


def brute_runs(w, least=12):
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapsed(w, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_texts(seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(60):
        w = [rnd.choice("abc" if rnd.random() < 0.5 else "abcdefghijklmnop") for _ in range(rnd.randrange(0, 70))]
        for _ in range(rnd.randrange(3)):
            at, unit = rnd.randrange(len(w) + 1), [rnd.choice("abcdé") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 9))]
            w[at:at] = (unit * 9)[: rnd.randrange(1, 40)]
        out.append(rnd.choice([" ", "\n", "\t ", "  "]).join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("least", [2, 12])
def test_runs_match_brute_force(spark, seed, least):
    texts = [*some_texts(seed), *(t for _, t, *_ in ODD), "a " * 11, "a " * 12, "x y " * 6, "x y " * 5 + "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in runs.periodic_runs(docs, least=least).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = word_list(t)
        if len(w) > 5000:
            assert [tuple(r) for r in got[i].runs] == [(0, 30000, 1)] and got[i].collapsed == "long One line"
            continue
        want = brute_runs(w, least)
        assert [tuple(r) for r in got[i].runs] == want and got[i].n_words == len(w) and got[i].collapsed == collapsed(w, want)


def test_many_texts_at_once_and_positions_in_pieces(monkeypatch):
    rnd = random.Random(5)
    texts = [[rnd.randrange(3) for _ in range(rnd.randrange(60))] for _ in range(200)]
    words, n = np.array([w for t in texts for w in t]), np.array([len(t) for t in texts])
    monkeypatch.setattr(runs, "_AT_ONCE", 7)
    start, end, period = runs.runs_of(words, n, 12)
    base, want = 0, []
    for t in texts:
        want += [(base + s, base + s + length, p) for s, length, p in brute_runs(t)]
        base += len(t)
    assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == want


def test_columns_of_all_names_stay_and_empty_tables(spark):
    names = ["row", "text", "n_words", "runs", "collapsed", "_w", "_n", "field", "Row2"]
    docs = spark.createDataFrame([tuple(["a b " * 8] * len(names))], ", ".join(f"{c} string" for c in names))
    out = runs.periodic_runs(docs)
    assert set(out.columns) == set(names) and out.first()["row"] == "a b " * 8 and out.first()["collapsed"] == "a b"
    assert runs.periodic_runs(docs.where("false")).count() == 0


def test_query_plants_periods(spark, tmp_path):
    rows = [(i, " ".join(str(k) for k in range(i % 37))) for i in range(150)] + [(None, "a b c"), (7, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect())))
    want = []
    for d, t in rows:
        w = word_list(t)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        best = min(((-length, s, p) for s, length, p in found), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(str((d, len(found), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda r: (r[0], r[2])))), sha(collapsed(w, found)))))
    assert got == sorted(want)
