import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import ann, epsilon
from pageloom.llm.queries import op2_embedding_near_dedup, op4_nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>"


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine):
    """(vec_id, links, component, kept) of every row."""
    n = len(rows)
    link = [[False] * n for _ in rows]
    for i in range(n):
        for j in range(n):
            u, v = rows[i][1], rows[j][1]
            if i != j and ok(u) and ok(v) and len(u) == len(v):
                u, v = np.array(u) / max(map(abs, u)), np.array(v) / max(map(abs, v))
                link[i][j] = u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[comp[i]] = min(least.get(comp[i], rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], sum(link[i]), least.get(comp[i]), rows[i][0] == least.get(comp[i])) for i in range(n)), key=str)


def clusters(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), width))
    return [(int(k), (centres[rng.integers(len(centres))] * rng.uniform(0.5, 3) + rng.normal(size=width) * rng.choice([0.02, 0.15, 0.3])).tolist()) for k in rng.permutation(n)]


@pytest.mark.parametrize("width, block", [(3, 8), (8, 16), (40, 1000)])
def test_epsilon_join_against_brute_force(spark, width, block):
    rows = clusters(90, width, width)
    got = epsilon.epsilon_join(spark.createDataFrame(rows, SCHEMA), 0.95, block).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows, 0.95)


def test_epsilon_join_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e200, 1e190]), (11, [1e-310, 0.0]), (None, [1.0, 0.001]), (None, None), (12, [-1.0, 0.0])]
    got = epsilon.epsilon_join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", links string"), 0.95, 4).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows, 0.95)


def test_epsilon_join_of_nothing(spark):
    assert epsilon.epsilon_join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in epsilon.epsilon_join(spark.createDataFrame([(1, None)], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(i, [1.0, rng.random() / 50, 0.0, rng.random() / 50]) for i in range(40, 100)] + [(100 + i, [0.0, 0.0, 1.0, float(i)]) for i in range(5)]
    got = epsilon.epsilon_join(spark.createDataFrame(rows, SCHEMA), 0.95, 16).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows, 0.95)


def test_near_dedup_query(spark, sf_dir):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in op2_embedding_near_dedup(spark, sf_dir).collect()}
    assert got == {r[0]: int(k) for r, k in zip(rows, links)}


def exact_nearest(rows, is_query, k):
    best = {}
    for q, v in rows:
        if is_query(q) and ok(v):
            near = {}
            for i, w in rows:
                if i is not None and i != q and ok(w):
                    s = float(sum(a * b for a, b in zip(v, w)))
                    near[i] = max(near.get(i, s), s)
            best[q] = sorted(near, key=lambda i: (-near[i], i))[:k]
    return best


def test_search_reaches_its_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 24)) * rng.uniform(0.5, 1, (1500, 1)))]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0", k=10, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact_nearest(rows, lambda q: q % 20 == 0, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


@pytest.mark.parametrize("most, told", [(1 << 20, 1), (500, 8)])
def test_a_task_keeps_the_nearest_of_all_its_blocks(most, told):
    rng = np.random.default_rng(11)
    q, x = rng.normal(size=(30, 6)), rng.normal(size=(400, 6))
    qids, ids = np.arange(30), np.arange(400)
    x[300:] = x[:100]  # rows that come again, as from another table
    ids[300:] = ids[:100]
    pairs = [{"qids": qids.astype("<i8").tobytes(), "q": q.tobytes(), "ids": ids[i : i + 25].astype("<i8").tobytes(), "x": x[i : i + 25].tobytes()} for i in range(0, 400, 25)]
    batches = pa.Table.from_pylist(pairs).to_batches(max_chunksize=3)
    got = [r for b in ann.nearest_of_blocks(iter(batches), 6, 10, most) for r in b.to_pylist()]
    assert len(got) <= told * 30 * 10
    for i in range(30):
        found = {r["vec_id"]: r["score"] for r in got if r["query_id"] == i}
        want = {j: s for j, s in enumerate(x[:300] @ q[i]) if j != i}
        best = sorted(found, key=lambda j: (-found[j], j))[:10]
        assert best == sorted(want, key=lambda j: (-want[j], j))[:10]
        assert all(math.isclose(found[j], want[j]) for j in best)


def test_search_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (20, []), (40, [0.0, 0.0]), (5, [float("nan"), 1.0]), (None, [1.0, 0.0]), (6, [0.5, 0.0]), (60, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0", k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got[0] == [(1, 60, 3.0), (2, 1, 1.0), (3, 2, 1.0), (4, 6, 0.5)]
    assert set(got) == {0, 60}
    assert ann.nearest(spark.createDataFrame([], SCHEMA), "vec_id % 20 = 0").count() == 0


def test_search_with_one_huge_component(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1000, 16)))]
    rows[17][1][3] = 1e200
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0", k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact_nearest(rows, lambda q: q % 20 == 0, 5)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def share_compared(spark, x, k=20):
    """What part of the rows a query compares, repeats between tables counted, and its recall, with hashes fitted to these rows."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    h = ann.fit_hashes(rows, k, 2, (3, 4, 5), 2.0, 0.75)
    ids = np.arange(0, len(x), 20)
    seen, compared = [set() for _ in ids], 0
    cells = h.buckets(x)
    for t, row, at in h.probes(x[ids], ids, 0.75):
        there = {}
        for i, c in enumerate(map(tuple, cells[:, t].tolist())):
            there.setdefault(c, []).append(i)
        for r, c in zip(row.tolist(), map(tuple, at.tolist())):
            own = there.get(c, [])
            compared += len(own)
            seen[r].update(own)
    hits = 0
    for s, i in zip(seen, ids.tolist()):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(s & set(np.argsort(-score)[:k].tolist()))
    return compared / len(ids) / len(x), hits / k / len(ids)


def test_share_compared(spark):
    """Where vectors lie in groups, a query compares a small part of them; where they are spread evenly in many dimensions, no more than two scans."""
    rng = np.random.default_rng(4)
    grouped = rng.normal(size=(100, 64))[np.arange(4000) % 100] + 0.1 * rng.normal(size=(4000, 64))
    share, recall = share_compared(spark, grouped / np.linalg.norm(grouped, axis=1)[:, None])
    assert share < 0.4 and recall >= 0.9
    share, recall = share_compared(spark, rng.normal(size=(4000, 64)))
    assert share < 2 and recall >= 0.9


def norms_of(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    if kind == "tail":
        return x * np.exp(1.5 * rng.normal(size=(3000, 1)))
    x[7] *= kind
    return x


@pytest.mark.parametrize("kind", [10, 1000, "tail"])
def test_search_where_norms_differ(spark, kind):
    """Long vectors neither hide the others nor make a query compare all."""
    x = norms_of(kind)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.nearest(rows, "vec_id % 20 = 0", k=20, block=256).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-score)[:20].tolist()))
        assert len(got[q]) == 20
    assert hits / 20 / 150 >= 0.9
    leveled, bands = ann.norm_bands(rows.selectExpr("vec_id", "embedding v"), 256)
    assert sum(n for *_, n in bands) == 3000 and [b[0] for b in bands] == sorted((b[0] for b in bands), reverse=True) and bands[-1][0] == 0
    assert kind == "tail" or [n for *_, n in bands] == [1, 2999]
    length = np.linalg.norm(x, axis=1)
    for r in leveled.select("vec_id", "level").collect():
        assert r.level == max(0, math.floor(math.log2(length[r.vec_id] / np.median(length)) + 0.02)) or r.level == max(0, math.floor(math.log2(length[r.vec_id] / np.median(length)) - 0.02))
    at = [r.vec_id for r in leveled.where("level = 0").collect()]
    share, recall = share_compared(spark, x[at])
    assert share < 2 and recall >= 0.85


@pytest.mark.parametrize("n, k", [(1, 20), (5, 20), (15, 20), (15, 3)])
def test_search_finds_all_of_a_few(spark, n, k):
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(0).normal(size=(n, 64)))]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), "true", k=k, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact_nearest(rows, lambda q: True, k)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}
    assert k < n or got == {q: v for q, v in want.items() if v}


def test_search_beside_large_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x[:1700] = rng.normal(size=(40, 64))[np.arange(1700) % 40] + 0.05 * x[:1700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = {True: [], False: []}
    for i in range(0, 2000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits[i < 1700].append(len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9


def test_search_query_recall(spark, sf_dir):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    got = {}
    for r in op4_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[int(ids[i])] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9
