"""Interval joins, places of hits, and overlapping chunks, by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunks, intervals, search


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join(spark, width):
    rng = random.Random(width)

    def made(n, start):
        return [(rng.choice("ab") if rng.random() < 0.5 else "hot", a := rng.randrange(200), a + rng.choice([0, 1, 3, 40, 150]), start + i) for i in range(n)]

    left, right = [*made(80, 0), (None, 1, 5, 900)], [*made(90, 0), (None, 1, 5, 901)]
    one = spark.createDataFrame(left, "k string, s long, e long, i int")
    two = spark.createDataFrame(right, "k string, rs long, re long, j int")
    got = sorted((r.i, r.j) for r in intervals.interval_join(one, two, "k", "s", "e", "rs", "re", width).collect())
    want = sorted((i, j) for k, a, b, i in left for m, c, d, j in right if k is not None and k == m and a < d and c < b and a < b and c < d)
    assert got == want


ENDS = ["\n", "\r\n", "\r", " ", "\x85", "\x0b"]


def test_where_hits_lie(spark):
    """Line ends of one to three bytes, blank lines, signs of several bytes; a line may lie in many chunks."""
    rng = random.Random(5)
    docs = []
    for i in range(60):
        body = "".join(rng.choice(["", " ", "abc é", "x𝄞 ABC ", "none", "abc" * 9]) + rng.choice(ENDS) for _ in range(rng.randrange(14)))
        docs.append((i, body + rng.choice(["", "last abc"])))
    docs += [(100, None), (101, ""), (102, "abc")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = chunks.chunk_spans(df, 10)
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, chunks.split_chunks(df, 10).select(*pieces.columns).collect()))
    for question in ("abc", "of", "é abc"):
        hits = intervals.located_hits(df, question, 5)
        rows = sorted((r.doc_id, r.hit_no, r.line, r.line_start, r.line_end) for r in hits.collect())
        assert [r[:3] for r in rows] == sorted(tuple(r) for r in search.search_lines(df, question, 5).collect())
        text = dict(docs)
        assert all(text[i].encode()[a:b].decode().strip() == line for i, _, line, a, b in rows)
        met = sorted((r.doc_id, r.hit_no, r.chunk_index) for r in intervals.chunks_of_hits(hits, pieces, 10).collect())
        assert met == sorted((i, n, k) for i, n, _, a, b in rows for k in range(a // 10, (b - 1) // 10 + 1))


def brute_chunks(words, size, overlap):
    ends = [bool(re.search(intervals.SENTENCE_END, w)) for w in words]
    out, step, n = [], size - overlap, len(words)
    for k, own in enumerate(range(0, n, step)):
        begins = [b for b in range(max(0, own - overlap), own + 1) if b == 0 or ends[b - 1]]
        begins = [b for b in begins if b > own - overlap or b == 0]
        a = max(begins, default=own)
        least = min(n, own + step + overlap)
        b = next((e for e in range(least, min(n, least + overlap) + 1) if ends[e - 1]), least)
        out.append((k, a, b, " ".join(words[a:b])))
    return out


@pytest.mark.parametrize(("size", "overlap"), [(8, 3), (5, 0), (64, 16), (4, 3)])
def test_overlapping_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = [" \n".join(rng.choice(["a", "b.", "c", "d!”", "é", "e.f", "…"]) for _ in range(n)) for n in [0, 1, 2, 3, 4, 5, 8, 9, 30, 64, 65, 200]]
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, " \t")], "doc_id long, text string")
    rows = intervals.sentence_chunks(df, size, overlap).collect()
    for i, t in enumerate(texts):
        words = t.split()
        mine = sorted((r.chunk_index, r.start_offset, r.end_offset, r.text) for r in rows if r.doc_id == i)
        assert mine == brute_chunks(words, size, overlap)
        covered = {k for _, a, b, _ in mine for k in range(a, b)}
        assert covered == set(range(len(words)))  # every word is somewhere
        assert all(a2 <= b1 for (_, _, b1, _), (_, a2, _, _) in zip(mine, mine[1:]))
        assert all(b - a <= size + 2 * overlap for _, a, b, _ in mine)
    assert {r.doc_id for r in rows} <= set(range(len(texts)))
    with pytest.raises(ValueError):
        intervals.sentence_chunks(df, 4, 4)


def test_offsets_reach_the_chunk_table(spark):
    from scriptorium.operators import catalog

    df = spark.createDataFrame([("d", "one two. three")], "doc_id string, text string")
    rows = catalog.chunk_table_rows(intervals.sentence_chunks(df, 2, 1).withColumn("text_preview", F.col("text")))
    got = sorted((r.chunk_index, r.start_offset, r.end_offset, r.token_count, r.text_preview) for r in rows.collect())
    assert got == [(0, 0, 2, 2, "one two."), (1, 0, 3, 3, "one two. three"), (2, 2, 3, 1, "three")]
