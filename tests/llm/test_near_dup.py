import random
import re

import numpy as np
import pytest

from scriptorium.llm import near_dup
from scriptorium.llm.near_dup import Near


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(docs, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    return {sets[k][0]: (len(sets[k][1]), min(groups[root(k)])) for k in range(len(sets))}


@pytest.fixture(scope="module")
def copies(prose):
    """A large group of near copies with much or little edited, chains, exact copies, and single texts."""
    rng = random.Random(9)
    base = prose(150, 100).split()
    texts = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 16)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(words))
    chain = prose(120, 101).split()
    for k in range(12):
        chain = [*chain[3:], *(f"new{k}{i}" for i in range(3))]
        texts.append(" ".join(chain))
    texts += [prose(n, 200 + n) for n in range(1, 60)] + [texts[0], texts[0].upper(), "", "one", "One", "one two", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, copies, width):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(docs, Near(shingle=width)).collect()}
    assert got == brute(copies, width)


def test_large_group_that_hardly_links(spark, prose):
    """Over a thousand edits of one text: most pairs share buckets and are just under the threshold, few are over it."""
    rng = random.Random(12)
    base = prose(60, 500).split()
    texts = []
    for k in range(1100):
        words = list(base)
        for i in rng.sample(range(len(words)), rng.choice([3, 4, 5, 6, 7])):
            words[i] = f"edit{k}x{i}"
        texts.append((k, " ".join(words)))
    texts += [(5000 + k, prose(80, 600 + k)) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), Near(shingle=2)).collect()}
    want = brute(texts, 2)
    assert len({c for _, c in want.values()}) > 100
    assert got == want


def test_estimate_is_close(spark):
    near = Near(shingle=2)
    hashes = near_dup.WordHashes()
    a = near_dup.shingles(" ".join(f"w{i}" for i in range(400)).encode(), 2, hashes)
    b = near_dup.shingles(" ".join(f"w{i}" for i in range(40, 440)).encode(), 2, hashes)
    rows = spark.createDataFrame([(near_dup.sketch(a, near)[1].tolist(), near_dup.sketch(b, near)[1].tolist())], "a array<long>, b array<long>")
    exact = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs(rows.select(near_dup.similarity(rows.a, rows.b, near)).first()[0] - exact) < 0.1
    assert rows.select(near_dup.similarity(rows.a, rows.a, near)).first()[0] == 1


def test_connected(spark):
    rng = random.Random(4)
    edges = [(a, a + 1) for a in range(60) if a % 20 != 19] + [(100, b) for b in range(101, 140)] + [(rng.randrange(200, 220), rng.randrange(200, 220)) for _ in range(15)]
    got = {r.node: r.root for r in near_dup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_one_of_each_group_stays(spark, copies):
    docs = spark.createDataFrame([(i, t, "x") for i, t in copies], "doc_id long, text string, node string")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute(copies, 5).items() if i == c)


def test_odd_rows(odd_docs, no_docs):
    rows = near_dup.components(odd_docs).collect()
    assert len(rows) == 12
    assert [r.component_id for r in rows if r.doc_id in (1, 6)] == [1, 1, 1]
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in rows if r.doc_id in (2, 3, 4))
    kept = near_dup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # of the repeated rows one stays, with or without an id
    assert sorted((r.doc_id is None, r.doc_id or 0, bool(r.text)) for r in kept.collect()) == sorted([(False, 1, True), (False, 2, False), (False, 3, False), (False, 4, True), (False, 5, True), (False, 7, True), (False, 8, True), (True, 0, True), (True, 0, False)])
    assert near_dup.components(no_docs).count() == 0
    assert near_dup.drop_near_duplicates(no_docs).count() == 0


def test_bits_keep_short_pairs():
    """The kept bits of the minima are independent of each other, so that no pair at the threshold is estimated away."""
    near = near_dup.Near(shingle=2)
    rng = np.random.default_rng(4)
    for size in (5, 10):
        for _ in range(3000 if size == 5 else 1000):
            x = np.unique(rng.integers(0, 2**64, size, np.uint64))
            one, two = (np.unpackbits(near_dup.sketch(s, near)[1].view(np.uint8)).reshape(near.bits, -1) for s in (x, x[: size * 4 // 5]))
            differ = (one != two).any(axis=0).sum()
            assert (1 - differ / near.minima - 0.25) / 0.75 >= near.least_estimate
