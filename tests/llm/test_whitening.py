"""Whitening against numpy on all vectors at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import whitening
from pageloom.llm.queries import QUERIES


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>").repartition(3)


def brute(rows, k=4):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, sums = len(fit), [sum(c) for c in zip(*sorted({tuple(x) for _, x in good}), strict=True)]
    m = fit - np.array([s / n for s in sums])
    v = m.T @ m / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    z = {i: (np.array(x) - np.array([s / n for s in sums])) @ vector / np.sqrt(value) for i, x in good}
    return n, {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in good}, z, value / np.trace(v)


def agree(got, rows, k=4, near=1e-8):
    n, deviation, z, explained = brute(rows, k)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in z for c in range(k))
    sign = {}
    for r in got:
        want = z[r.vec_id][r.component - 1]
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error <= 1e-6
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        if abs(want) > 1e-3:
            sign.setdefault(r.component, math.copysign(1, want * r.whitened))
        assert abs(sign.get(r.component, 1) * r.whitened - want) < near


ODD = [(-1, None), (-2, [math.nan] * 20), (-3, [math.inf] + [0] * 19), (-4, [None] + [1] * 19), (-5, [0] * 20)]


def spread(rank, n=400, width=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, rank)) * 2.0 ** -np.arange(rank) @ rng.standard_normal((rank, width))
    return [(i, v.tolist()) for i, v in enumerate((x + 0.01 * rng.standard_normal(x.shape)).astype(np.float32))]


def test_falling_values_are_found_from_few_directions(spark):
    rows = spread(6)
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + ODD
    df = table(spark, rows)
    w = whitening.fit(df.where(whitening.in_use(df.embedding)).select(whitening.scaled(df.embedding).alias("x")), oversample=6)
    assert not w.full and w.n == 401 and w.vectors.shape == (20, 4)
    agree(whitening.whiten(df, oversample=6).collect(), rows)


def test_close_values_take_all_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 30)).astype(np.float32))]
    df = table(spark, rows)
    w = whitening.fit(df.select(whitening.scaled(df.embedding).alias("x")), oversample=2, passes=3)
    assert w.full and w.passes == 4
    agree(whitening.whiten(df, oversample=2, passes=3).collect(), rows)


def test_equal_values_span_the_same_space(spark):
    rows = [(i, [4.0 * (i == j) - 4.0 * (i == j + 6) for j in range(6)]) for i in range(12)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 48 and max(r.identity_error for r in got) < 1e-9 and {round(r.explained, 9) for r in got} == {round(1 / 6, 9)}


def test_few_or_no_vectors_and_large_numbers(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, ODD[:4])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in two) == [("1", 1, 2, 512**2, 1, 1), ("2", 1, 2, 512**2, 1, 1), ("None", 1, 2, 512**2, 1, 1)]
    big = [(1, [2.0**40, 0]), (2, [-(2.0**40), 1]), (3, [2.0**52, 5])]
    got = whitening.whiten(table(spark, big, "double"), components=1).collect()
    assert all(r.deviation is None for r in got) and len(got) == 3
    ragged = whitening.whiten(table(spark, [(1, [1.0]), (2, [3.0, 2.0]), (3, [0.0, 7.0])])).collect()
    assert len(ragged) == 6


@pytest.mark.parametrize("extra", ["x", "id", "component", "n"])
def test_other_columns_are_not_looked_at(spark, extra):
    df = table(spark, spread(3, n=30, width=5)).withColumn(extra, F.lit("z"))
    assert whitening.whiten(df).count() == 120


def test_query(spark, sf_dir):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    agree(QUERIES["op12_embedding_whitening"](spark, sf_dir).collect(), [(r["vec_id"], r["embedding"]) for r in t], near=1e-6)
