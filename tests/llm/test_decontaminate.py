import random
import re

import pytest

from scriptorium.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(prose):
    rng = random.Random(8)
    items = [(i, prose(rng.randrange(8, 40), 500 + i)) for i in range(20)]
    items += [(20, "Short item"), (21, "seven words that stand here for matching"), (22, ""), (23, None), (24, items[0][1]), (25, "the the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        text = prose(rng.randrange(0, 120), 900 + i).split(" ")
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(w))
            part = w[a : a + rng.randrange(1, 40)]
            at = rng.randrange(len(text) + 1)
            text = [*text[:at], *part, *text[at:]]
        docs.append((i, rng.choice([" ", "  ", ", ", "\n"]).join(text)))
    docs += [(60, items[3][1].upper() + "!"), (61, " ".join(["the"] * 15)), (62, None), (63, ""), (63, ""), (64, "a short, ITEM b"), (None, items[5][1]), (None, items[5][1]), (65, "über Äpfel ÄPFEL x9")]
    return docs, items


def test_against_brute_force(spark, tables):
    docs, items = tables
    got = decontaminate.summary(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in got)


def test_clean_keeps_the_others(spark, tables):
    docs, items = tables
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, h int")
    kept = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted((i, t) for i, t in docs if t and i is not None and not brute([(i, t)], items)[0][2])


def test_windows_guarantee_fingerprints():
    # a shared span of a window has the same smallest gram in both texts by construction; the widths must fit
    assert decontaminate.WINDOW >= decontaminate.GRAM


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    rows = decontaminate.summary(odd_docs, items).collect()
    assert len(rows) == 12
    assert [r.doc_id for r in rows if r.contaminated] == [7]
    assert decontaminate.summary(no_docs, items).count() == 0
    assert decontaminate.summary(odd_docs, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.clean(odd_docs, items.where("false")).count() == 12
    assert decontaminate.clean(no_docs, items).count() == 0


def test_a_very_long_item(spark, prose):
    """All of an item of 40,000 words counts, wherever a document shares a window with it."""
    long = " ".join(f"{w}q{i}" for i, w in enumerate(prose(40_000, 77).split()))
    some = " ".join(long.split()[31_000:31_012])
    docs = spark.createDataFrame([(1, f"before {some} after"), (2, long), (3, " ".join(long.split()[:9]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.summary(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()}
    assert got == {1: (12, True), 2: (40_000, True), 3: (0, False)}
