"""Nearest vectors, by brute force."""

import numpy as np
import pytest

from scriptorium.operators import vectors

DDL = "vec_id long, embedding array<float>"


def made(n, width, groups, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    return (middle[rng.integers(groups, size=n)] + 0.7 * rng.normal(size=(n, width))).astype(np.float32)


def brute(data, asked, k):
    unit = data.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = np.round(unit @ unit[q], 9)
        out[q] = [(i, score[i]) for i in sorted((i for i in range(len(data)) if i != q), key=lambda i: (-score[i], i))[:k]]
    return out


def read(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.asked, r["rank"])):
        out.setdefault(r.asked, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_search(spark, monkeypatch, block):
    """A third of the rows is one vector."""
    monkeypatch.setattr(vectors, "QUESTIONS", block)
    data = made(600, 8, 5, 1)
    data[::3] = data[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], DDL).repartition(4)
    index = vectors.VectorIndex.build(df, 16)
    got, want = read(index.search(df.where("vec_id % 20 = 0"), 6)), brute(data, range(0, 600, 20), 6)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 2e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_recall_of_probes(spark):
    data = made(3000, 16, 40, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], DDL).repartition(4)
    index = vectors.VectorIndex.build(df, 32, sample=1000)
    got, want = read(index.search(df.where("vec_id % 20 = 0"), 10, 10)), brute(data, range(0, 3000, 20), 10)
    found = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in x}) for q, x in want.items())
    assert found >= 0.9 * 10 * len(want)
    assert sum(b.list is not None for b in spark.read.parquet(index.path).select("list").collect()) == 3000  # every row is in a list


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], DDL + ", unit string")
    got = read(vectors.VectorIndex.build(df).search(df, 2))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [1, 10], 1: [0, 10], 2: [10, 0], 10: [0, 1]}
    none = vectors.VectorIndex.build(df.where("vec_id > 2 and vec_id < 8"))
    assert none.search(df, 3).collect() == []
    assert vectors.VectorIndex.build(df).search(df.limit(0), 3).collect() == []


def test_the_chunks_of_what_is_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], DDL)
    pointers = spark.createDataFrame([("a", 1, "m"), ("b", 1, "m"), ("c", 0, "m")], "chunk_id string, vector_index int, model_name string")
    found = vectors.chunks_of(vectors.VectorIndex.build(df).search(df.where("vec_id = 0"), 1), pointers)
    assert sorted((r.asked, r.vec_id, r.chunk_id) for r in found.collect()) == [(0, 1, "a"), (0, 1, "b")]
