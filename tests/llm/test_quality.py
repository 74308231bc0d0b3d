import re
from collections import Counter

import duckdb

from scriptorium.llm import quality, queries


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, s in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", s) and s in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_against_brute_force(spark, prose):
    texts = [prose(n, n) for n in (0, 1, 2, 3, 49, 50, 51, 300)]
    texts += ["a b c a b c", "a a a a", "x\ny\nx\n x\nx\n\n", "a b c d a b c a b", "é ü # * $", None, "\x1f\x85 a", "a\r\nb\r\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bits_and_policies(spark, prose):
    docs = spark.createDataFrame([(0, prose(60, 1)), (1, "a b"), (2, "x y z " * 40), (3, " ".join(f"{w}{i} #" for i, w in enumerate(prose(60, 2).split())))], "doc_id long, text string")
    book = quality.ledger(docs)
    bits = {r.doc_id: r.failed_bits for r in book.collect()}
    assert bits[0] == 0
    assert bits[1] & quality.BIT["too_few_words"]
    assert bits[2] & quality.BIT["repeated_windows"]
    assert bits[3] == quality.BIT["symbols"]
    assert {r.doc_id for r in book.where(quality.passes(1)).collect()} == {0, 3}
    assert {r.doc_id for r in book.where(quality.passes(2)).collect()} == {0}


def test_ablation(spark, prose):
    docs = spark.createDataFrame([(0, prose(60, 1)), (1, "a b"), (2, "x y z " * 40), (3, "x y z " * 2)], "doc_id long, text string")
    book = quality.ledger(docs)
    rows = book.collect()
    for r in quality.ablation(book).collect():
        fails = [x.failed_bits & quality.POLICIES[quality.CURRENT_POLICY] for x in rows]
        assert r.n_failed == sum(1 for f in fails if f & r.bit)
        assert r.n_only_this == sum(1 for f in fails if f == r.bit)
    assert quality.ablation(book).count() == 6


def test_odd_rows(odd_docs, no_docs):
    assert quality.ledger(odd_docs).count() == 12
    kept = quality.accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, r.n_words) for r in kept.collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (5, 0), (6, 0)]
    assert quality.ledger(no_docs).count() == 0
    assert quality.accepted(no_docs).count() == 0


def test_ablation_query_against_sql(spark, prose, tmp_path):
    texts = [prose(60, 1), prose(10, 2), None, "", "a b c " * 40, "# $ % & " * 20, "same line here\n" * 6, prose(60, 3) + "\n" + "x" * 4000, "a " * 70]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.quality_ablation(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.execute(queries.oracle_sql()["quality_ablation"]).fetchall())
    assert {r[0] for r in got} == set(quality.BIT)
