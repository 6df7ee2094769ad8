"""Nearest vectors against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm.similar_vectors import Index, kmeans, most_similar, nearest


def data(seed=0, n=1500):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64)) + 2 * r.normal(size=(12, 64))[r.integers(0, 12, n)]
    x[n // 2 :: 7] = x[: len(x[n // 2 :: 7])] + 0.15 * r.normal(size=(len(x[n // 2 :: 7]), 64))
    return x.astype(np.float32)


def exact(x, ids, k):
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = m.astype(np.float64) @ m.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    return {ids[i]: [(ids[j], s[i, j]) for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(ids))}


def frame(spark, ids, x, extra=()):
    return spark.createDataFrame([*((i, v.tolist()) for i, v in zip(ids, x)), *extra], "key string, vec array<float>").withColumn("id", F.lit(1)).withColumn("q", F.lit("x")).withColumn("rid", F.lit("x"))


@pytest.fixture(scope="module")
def found(spark):
    x = data()
    ids = [f"v{i:05d}" for i in range(len(x))]
    odd = [("null", None), ("empty", []), ("zero", [0.0] * 64), ("short", [1.0] * 48), (None, x[0].tolist()), ("hole", [None] + [1.0] * 63), ("nan", [float("nan")] * 64), (ids[5], x[5].tolist())]
    df = frame(spark, ids, x, odd)
    return x, ids, df


def test_recall(found):
    x, ids, df = found
    want = exact(x, ids, 5)
    got = {}
    for r in most_similar(df, "key", "vec", 5, block=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbour_id, r.cosine))
    assert set(got) == set(ids) and all(sorted(k for k, *_ in v) == [1, 2, 3, 4, 5] for v in got.values())
    hit = sum(len({n for _, n, _ in got[i]} & {n for n, _ in want[i]}) for i in ids) / (5 * len(ids))
    assert hit >= 0.9


def test_floor_and_queries(found):
    x, ids, df = found
    want = {(i, n) for i, v in exact(x, ids, 5).items() for n, c in v if c >= 0.95}
    got = {(r.query_id, r.neighbour_id) for r in most_similar(df, "key", "vec", 5, min_cosine=0.95).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and want
    few = most_similar(df, "key", "vec", 3, queries=F.col("key") < "v00020")
    assert {r.query_id for r in few.collect()} == set(ids[:20])


def test_copies(spark):
    x = data(1, 300)
    rows = [(f"c{i:03d}", x[0] * (1 + i % 3)) for i in range(120)] + [(f"v{i:03d}", x[i]) for i in range(1, 300)]
    df = frame(spark, [k for k, _ in rows], [v for _, v in rows])
    got = most_similar(df, "key", "vec", 5, block=16).collect()
    for q in ("c000", "c003", "c119"):
        near = [r for r in got if r.query_id == q]
        assert len(near) == 5 and all(r.neighbour_id.startswith("c") and r.cosine > 0.9999 for r in near)
    assert {r.query_id for r in got} == {k for k, _ in rows}


def test_few_or_none(spark):
    none = spark.createDataFrame([], "key string, vec array<float>")
    assert most_similar(none, "key", "vec", 5).count() == 0
    two = frame(spark, ["a", "b"], data(2, 20)[:2])
    assert {(r.query_id, r.neighbour_id) for r in most_similar(two, "key", "vec", 5).collect()} == {("a", "b"), ("b", "a")}


def test_asymmetric_distance():
    x = data(3, 600)
    index = Index(x[:2], kmeans(x, 6), np.array([1, 0, 1, 0, 1, 1]), x, 2)
    d = np.stack([((x[0] - y) ** 2).sum() for y in x])
    r = x[0] - index.cells
    cell = int((r**2).sum(1).argmin())
    brute = nearest(x, index.cells, 3)
    assert (index.near(x, 3) == brute).all()  # all top cells are visited
    some = Index(x[:2], index.cells, np.array([0, 0, 1, 1, 1, 1]), x, 1).near(x, 3)
    assert (some[:, 0] >= 0).all() and (some[:, 2] == -1).any() and (np.sort(some, 1)[:, 1:] != np.sort(some, 1)[:, :-1])[some.min(1) >= 0].all()
    own = np.flatnonzero(nearest(x, index.cells, 1)[:, 0] == cell)
    codes = index.encode(x[own], np.full(len(own), cell))
    est = index.distances(x[:1], cell, codes)[0] + ((x[0] - index.cells[cell]) ** 2).sum()
    assert np.corrcoef(est, d[own])[0, 1] > 0.9
