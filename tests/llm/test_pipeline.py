"""The whole pipeline, and each stage on its own input, on documents with planted cases."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, prose, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    good = {i: prose(120, 3000 + i) for i in range(30)}
    item = prose(30, 4000)
    docs = dict(good)
    docs[100] = good[3]  # exact copy
    docs[101] = " ".join([*good[4].split()[:-2], "changed", "ending"])  # near copy
    docs[102] = good[5] + " " + " ".join(item.split()[4:20]) + " " + prose(40, 1)  # benchmark passage
    docs[103] = prose(100, 2) + " mail bob.ray@mail.example.com or 97.51.17.173"
    docs[104] = "too short"
    docs[105] = "x y z " * 60
    docs[106] = None
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").distinct().collect()) for n, d in held.items()}
    good = list(range(30))
    assert ids["quality_rules"] == [*good, 100, 101, 102, 103]
    assert ids["near_duplicates"] == [*good, 102, 103]
    assert ids["decontamination"] == [*good, 103]
    assert ids["pii_surrogates"] == ids["packing"] == ids["decontamination"]
    text = held["pii_surrogates"].where("doc_id = 103").first()
    assert "bob.ray" not in text.text and "97.51.17.173" not in text.text
    assert re.search(r"mail \S+@\S+\.example or \d+\.\d+\.\d+\.\d+$", text.text)
    assert text.n_chars == len(text.text)
    before = {r.doc_id: r.text for r in held["decontamination"].collect()}
    assert all(r.text == before[r.doc_id] for r in held["pii_surrogates"].collect() if r.doc_id != 103)


def test_run(spark, sf_dir):
    rows = __spark_entry__.queries()["pipeline"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {*range(30), 103}


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


#: Names that the stages use themselves.
CLASHING = ["failed_bits", "n_words", "component", "node", "keys", "_id", "_hash", "_codes", "_new", "c0", "piece", "contaminated"]


def odd_rows(spark, rows):
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None, "src", None, *CLASHING) for i, t in rows], ddl)


def test_odd_rows(spark, prose, sf_dir):
    """Null ids and texts, an empty and a very long text, repeated rows, ties and clashing names, by each stage on its own."""
    long = " ".join(f"{w}x{i}" for i, w in enumerate(prose(40000, 7001).split()))
    one, two = prose(90, 7002), prose(90, 7003)
    rows = [(1, long), (2, one), (2, one), (None, one), (3, None), (3, None), (4, ""), (5, two), (5, one), (None, two), (None, None)]
    docs = odd_rows(spark, rows).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert all([r[c] for c in CLASHING] == CLASHING for r in out.select(*(f"`{c}`" for c in CLASHING)).collect())
        return sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=str)

    ordered = lambda found: sorted(found, key=str)
    assert after("quality_rules") == ordered(r for r in rows if r[1])
    # of each text the least id stays once; texts without words stay, but for repeats of id and text
    assert after("near_duplicates") == ordered([(1, long), (2, one), (5, two), (3, None), (4, ""), (None, None)])
    assert after("decontamination") == ordered(rows)
    assert after("pii_surrogates") == ordered(rows)
    packed = stages["packing"](spark, docs, sf_dir).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        ends = [0, *(o + n for o, n in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024


def test_empty_table(spark, sf_dir):
    docs = odd_rows(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        assert name == "packing" or out.columns == docs.columns


def test_no_benchmark(spark, prose, tmp_path):
    """Without items nothing is contaminated."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_rows(spark, [(i, prose(90, 7100 + i)) for i in range(5)])
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(5))
