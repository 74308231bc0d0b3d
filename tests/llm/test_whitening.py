import random
from fractions import Fraction
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 100), st.integers(1, 6), st.integers(0, 9), st.randoms(use_true_random=False))
def test_products_are_exact(bits, width, n, rng):
    rows = [[rng.randint(-(2**bits) + 1, 2**bits - 1) for _ in range(width)] for _ in range(n)]
    block = np.array(rows, object if bits > 62 else np.int64).reshape(n, width)
    count = whitening.limb_count(bits)
    parts = whitening.limbs(block, count)
    assert all(np.abs(p).max(initial=0) <= 1 << whitening.LIMB for p in parts)
    assert all(sum(int(p[i, j]) << whitening.LIMB * k for k, p in enumerate(parts)) == rows[i][j] for i in range(n) for j in range(width))
    got = whitening.gram(block, count)
    assert [[got[i, j] for j in range(width)] for i in range(width)] == [[sum(r[i] * r[j] for r in rows) for j in range(width)] for i in range(width)]


def test_a_full_block_stays_exact():
    """The largest limbs in as many rows as a block has."""
    block = np.full((whitening.ROWS, 2), (1 << 39) - 1, np.int64)
    assert whitening.gram(block, whitening.limb_count(39))[0, 1] == whitening.ROWS * ((1 << 39) - 1) ** 2


@given(st.integers(-(2**200), 2**200))
def test_digits(n):
    assert whitening.number_of(list(enumerate(whitening.digits_of(n)))) == n


def brute(rows, components):
    """The contract in fractions: n, deviations by row, covariance of the distinct vectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    xs = [(i, tuple(floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = [[sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    order = np.argsort(-values)[:components]
    white = {x: np.array([float(c - Fraction(t, n)) for c, t in zip(x, s)]) @ vectors[:, order] / np.sqrt(values[order]) for x in fit}
    deviation = {x: sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in fit}
    return xs, n, deviation, white, values[order] / float(sum(v[j][j] for j in range(d)))


def compare(got, rows, components=16):
    xs, n, deviation, white, explained = brute(rows, components)
    k = len(explained)
    assert len(got) == len(xs) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = np.ones(k)
    first = True
    for i, x in xs:
        mine = [by[i][c + 1][0] for c in range(k)]
        assert all(r.n == n and r.deviation == deviation[x] and r.identity_error <= 1e-9 for r in mine)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        w = np.array([r.whitened for r in mine])
        if first and np.abs(white[x]).min() > 1e-3:
            signs, first = np.sign(w * white[x]), False
        if not first:
            assert np.allclose(w, signs * white[x], atol=1e-6)
    assert not first


def vectors(n, d, seed, spread=3.0):
    rng = random.Random(seed)
    scale = [spread / (j + 1) for j in range(d)]
    return [(i, [rng.gauss(5, s) for s in scale]) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "components"), [(60, 5, 16), (200, 20, 16), (40, 3, 2)])
def test_by_brute_force(spark, n, d, components):
    rows = vectors(n, d, n)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # a vector that repeats
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), components).collect()
    compare(got, rows, components)


def test_integers_too_wide_for_a_long(spark):
    """Centred entries beyond 62 bits: Python integers, and deviations that no long holds are null."""
    rows = [(i, [float(2**52) * (i * 7 % 11 - 5), float(2**52) * (i * i % 13 - 6)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    assert len(got) == 80 and {r.deviation for r in got} == {None}
    assert all(r.identity_error < 1e-9 and r.n == len({tuple(v) for _, v in rows}) for r in got)


def test_odd_rows(spark):
    good = vectors(50, 4, 3)
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [nan, 1.0, 1.0, 1.0]), (103, [1.0, inf, 1.0, 1.0]), (104, [1.0, 1.0, -inf, 1.0])]
    ragged = [(105, []), (106, [1.0]), (107, [3e38, 1.0, 1.0, 1.0])]
    rows = [*good, *bad, *ragged]
    docs = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], SCHEMA + ", x string, n int")
    compare(whitening.whiten(docs).collect(), good)
    none = whitening.whiten(docs.where("vec_id = 100")).collect()
    assert none == whitening.whiten(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], SCHEMA)
    assert whitening.whiten(same).collect() == []
    null = spark.createDataFrame([(None, v) for _, v in good], SCHEMA)
    assert len(whitening.whiten(null).collect()) == 200


def test_fewer_vectors_than_dimensions(spark):
    """Components without variance do not exist."""
    got = whitening.whiten(spark.createDataFrame(vectors(4, 9, 8), SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert all(r.identity_error < 1e-6 for r in got)
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9
