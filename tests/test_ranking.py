"""Ranking by relevance, by brute force."""

import random
import re
from collections import Counter
from contextlib import contextmanager
from math import log

import pytest

from scriptorium import scratch
from scriptorium.operators import ranking
from scriptorium.scratch import new_folder


def brute(rows, question, top):
    docs = [(i, re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows if i is not None]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    out = []
    for i, words in docs:
        tf, score = Counter(words), 0.0
        for term in set(re.findall(r"[^\W_]+", question.lower())):
            df = sum(term in w for _, w in docs)
            if tf[term]:
                score += log(1 + (n - df + 0.5) / (df + 0.5)) * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if any(tf[t] for t in re.findall(r"[^\W_]+", question.lower())):
            out.append((i, score))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:top]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(700)]
    return [*out, (900, None), (901, ""), (902, "Été w1, ÉTÉ!"), (903, "rare " * 400), (None, "rare"), (904, "w1 w2")]


@pytest.mark.parametrize(("block", "first"), [(4096, 8), (20, 2), (7, 1)])
def test_as_brute_force(spark, rows, monkeypatch, block, first):
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "FIRST", first)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = ranking.RankIndex(spark, new_folder(spark, "ranks"), 8)
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1 or doc_id is null"))  # it grows
    for question in ("w1 w2 w7", "rare", "ÉTÉ w1 w1", "w1 nothing", "nothing", "", "?!", "w3"):
        for top in (1, 10):
            got = index.search(question, top).collect()
            want = brute(rows, question, top)
            assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(want) + 1))
            ordered = sorted(got, key=lambda r: r["rank"])
            assert all(abs(r.score - s) < 1e-9 for r, (_, s) in zip(ordered, want, strict=True))
            assert [r.doc_id for r in ordered] == [i for i, _ in want] or len({round(s, 9) for _, s in want}) < len(want)


def test_blocks_below_the_worst_score_are_not_read(spark, monkeypatch):
    """One block holds the term often, the others hardly."""
    monkeypatch.setattr(ranking, "BLOCK", 10)
    monkeypatch.setattr(ranking, "FIRST", 1)
    docs = [(i, "x " * (20 if i < 10 else 1) + "y " * 20) for i in range(200)]
    index = ranking.indexed(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 4)
    read = []
    join = ranking.broadcast_if_few
    monkeypatch.setattr(ranking, "broadcast_if_few", lambda df: read.append(df.count()) or join(df))
    assert sorted(r.doc_id for r in index.search("x", 10).collect()) == list(range(10))
    assert read == [1, 0]


def test_few_texts_pass_through_python_at_once(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    @contextmanager
    def noted(session):
        with scratch.text_batches(session):
            seen.append(session.conf.get(name))
            yield

    monkeypatch.setattr(ranking, "text_batches", noted)
    before = spark.conf.get(name)
    ranking.indexed(spark.createDataFrame([(1, "a river")], "doc_id long, text string"), 1)
    assert seen == ["1000"] and spark.conf.get(name) == before
