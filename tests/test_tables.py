"""Tables by manifest, the text store on them, and as-of joins."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from scriptorium import schema
from scriptorium.engine import Engine
from scriptorium.operators import catalog
from scriptorium.operators.asof import as_of
from scriptorium.operators.retention import latest
from scriptorium.sources import tables
from scriptorium.sources.store import TextStore
from scriptorium.sources.tables import Table

DDL = "doc_id string, n int"
START = datetime.datetime(2024, 1, 1)


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, DDL)


def all_of(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), DDL, buckets=4)


def test_appends_and_versions(spark, table):
    assert all_of(table) == []
    table.append(rows_of(spark, [("a", 1), ("b", 2)]))
    first = table.held()[0]
    table.append(rows_of(spark, [("a", 3)]))
    table.append(rows_of(spark, []))
    assert all_of(table) == [("a", 1), ("a", 3), ("b", 2)]
    assert sorted(tuple(r) for r in table.read(version=first).collect()) == [("a", 1), ("b", 2)]


def test_a_reader_between_two_appends(spark, table, monkeypatch):
    """What has been written but is not yet in a manifest is not read, and a plan that was made before stays as it was."""
    table.append(rows_of(spark, [("a", 1)]))
    before, seen = table.read(), []
    publish = Table._publish
    monkeypatch.setattr(Table, "_publish", lambda self, *a: seen.append(all_of(self)) or publish(self, *a))
    table.append(rows_of(spark, [("a", 2), ("b", 2)]))
    assert seen == [[("a", 1)]] and len(all_of(table)) == 3
    assert before.count() == 1


def test_no_append_is_lost(spark, table):
    """Writers of one moment: each finds its number taken and says its change again."""
    threads = [threading.Thread(target=table.append, args=(rows_of(spark, [(f"k{i}", i)]),)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all_of(table) == [(f"k{i}", i) for i in range(6)]
    assert table.held()[0] == 6


def test_a_number_is_given_once(spark, table):
    assert table._publish(1, {"0": ["x"]}) and not table._publish(1, {"0": ["y"]})
    assert table.held() == (1, {"0": ["x"]})


def summed(held, new):
    return held.unionByName(new).groupBy("doc_id").agg(F.sum("n").cast("int").alias("n"))


def test_a_merge_touches_the_buckets_of_its_keys(spark, table):
    table.append(rows_of(spark, [(f"k{i}", i) for i in range(40)]))
    before = table.held()[1]
    table.merge(rows_of(spark, [("k7", 100)]), summed)
    after = table.held()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    assert all_of(table) == sorted((f"k{i}", i + 100 * (i == 7)) for i in range(40))
    one = spark.createDataFrame([("k7",)], "doc_id string")
    assert len(table.read(one).inputFiles()) < len(table.read().inputFiles())
    assert [r.n for r in table.read(one).where("doc_id = 'k7'").collect()] == [107]


def test_a_merge_starts_again_when_its_bucket_has_changed(spark, table):
    table.append(rows_of(spark, [("a", 1)]))
    calls = []

    def fold(held, new):
        if not calls:
            calls.append(1)
            table.append(rows_of(spark, [("a", 10)]))  # another writer, meanwhile
        return summed(held, new)

    table.merge(rows_of(spark, [("a", 100)]), fold)
    assert all_of(table) == [("a", 111)]


def test_what_is_appended_during_a_compaction_stays(spark, table):
    for n in (1, 2):
        table.append(rows_of(spark, [("a", n), ("b", n)]))

    def fold(held):
        table.append(rows_of(spark, [("a", 9)]))
        return held.groupBy("doc_id").agg(F.max("n").alias("n"))

    table.compact(fold)
    assert all_of(table) == [("a", 2), ("a", 9), ("b", 2)]
    assert table.vacuum() >= 2
    assert all_of(table) == [("a", 2), ("a", 9), ("b", 2)]
    assert table.vacuum() == 0


def test_too_many_conflicts(spark, table, monkeypatch):
    monkeypatch.setattr(tables, "ATTEMPTS", 2)
    monkeypatch.setattr(Table, "_publish", lambda *a: False)
    with pytest.raises(tables.Conflict):
        table.append(rows_of(spark, [("a", 1)]))


def test_engine_writes_one_bucket_for_one_document(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    many = spark.createDataFrame([(None, f"f{i}.txt", f"text {i}") for i in range(60)], "user_id string, filename string, text string")
    assert engine.ingest(many).count() == 60
    held = {t: getattr(engine, t).held()[1] for t in ("documents", "chunks")} | {"texts": engine.store.table.held()[1]}
    engine.ingest(many.limit(1))
    now = {t: getattr(engine, t).held()[1] for t in ("documents", "chunks")} | {"texts": engine.store.table.held()[1]}
    for t in held:
        assert sum(now[t].get(b) != held[t].get(b) for b in now[t]) == 1
    fs, folder = engine.documents._folder(engine.staging)
    assert len(fs.listStatus(folder)) == 0  # nothing stays behind


def test_engine_upserts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    first = spark.createDataFrame([("d", "u1", "a.txt", 5, 1), ("e", "u2", "b.txt", 6, 2)], "doc_id string, user_id string, filename string, size_bytes long, seq long")
    engine.upsert(first)
    engine.upsert(spark.createDataFrame([("d", "other", "c.txt", None, 1)], first.schema))
    got = {r.doc_id: (r.user_id, r.filename, r.size_bytes, r.status) for r in engine.catalog().collect()}
    assert got == {"d": ("u1", "c.txt", None, "uploaded"), "e": ("u2", "b.txt", 6, "uploaded")}
    chunk = "chunk_id string, doc_id string, chunk_index int, text_preview string"
    engine.add_chunks(spark.createDataFrame([("c", "d", 0, "first"), ("c", "d", 1, "second")], chunk))
    engine.add_chunks(spark.createDataFrame([("c", "d", 2, "third"), ("x", "d", 0, "other")], chunk))
    assert {r.chunk_id: r.text_preview for r in engine.chunks.read().collect()} == {"c": "first", "x": "other"}


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_store_by_time(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "s"), ttl=100)
    ddl = "doc_id string, text string, stored_at timestamp"
    store.put(spark.createDataFrame([("a", "old", at(0)), ("a", "new", at(50)), ("b", "only", at(20)), (None, "x", at(0)), ("", "y", at(0))], ddl))
    store.put(spark.createDataFrame([("a", "newest of one time", at(50))], ddl))
    store.clear(spark.createDataFrame([("b",)], "doc_id string"), at=at(60))
    asked = spark.createDataFrame([("a", at(s), s) for s in (-1, 0, 49, 50, 150, 151)] + [("b", at(s), s) for s in (20, 59, 60)] + [(None, at(1), 1), ("a", None, 2), ("zz", at(5), 5)], "doc_id string, asked_at timestamp, s int")
    got = {(r.doc_id, r.asked_at and r.s): r.text for r in store.texts_as_of(asked).collect()}
    assert got == {("a", -1): "", ("a", 0): "old", ("a", 49): "old", ("a", 50): "newest of one time", ("a", 150): "newest of one time", ("a", 151): "", ("b", 20): "only", ("b", 59): "only", ("b", 60): "", (None, 1): "", ("a", None): "", ("zz", 5): ""}
    for s in (-1, 0, 49, 50, 150, 151):  # the same as one read at that time
        assert {r.text for r in store.get(spark.createDataFrame([("a",)], "doc_id string"), at(s)).collect()} == {got["a", s]}
    store.compact()
    assert sorted((r.doc_id, r.text) for r in store.table.read().collect()) == [("a", "newest of one time")]
    assert "text" not in store.versions().columns


@pytest.mark.parametrize("partitions", [1, 7])
def test_as_of_by_brute_force(spark, partitions):
    """A hot key among others, equal times, versions of one moment."""
    rng = random.Random(partitions)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice("abc")
    versions = [(key(), rng.randrange(60), i) for i in range(150)] + [(None, 1, 900), ("a", None, 901)]
    asked = [(key(), rng.randrange(-3, 70), i) for i in range(400)] + [(None, 5, 1000), ("b", None, 1001), ("none", 5, 1002)]
    right = spark.createDataFrame(versions, "k string, t int, v int").repartition(partitions)
    left = spark.createDataFrame(asked, "k string, t int, q int").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.q: r.version and r.version.v for r in as_of(left, right, "k", "t", "t", ["v"]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {q: max(((vt, v) for vk, vt, v in versions if k is not None and vk == k and t is not None and vt is not None and vt <= t), default=(0, None))[1] for k, t, q in asked}
    assert got == want


def test_latest_leaves_the_rest_alone(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("b", 2, 1)], "doc_id string, stored_at int, written int")
    assert sorted(tuple(r) for r in latest(rows, "doc_id", ["stored_at", "written"]).collect()) == [("a", 1, 7), ("b", 2, 1)]
    assert catalog.with_statuses(spark.createDataFrame([("a", "s", START)], "doc_id string, status string, updated_at timestamp"), spark.createDataFrame([], schema.STATUSES)).first().status == "s"


def test_questions_answered_as_of_their_time(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"), ttl=100)
    engine.store.put(spark.createDataFrame([("a", "first text", at(0)), ("a", "second text", at(50))], "doc_id string, text string, stored_at timestamp"))
    asked = spark.createDataFrame([("a", "text", at(10)), ("a", "text", at(60)), ("a", "text", at(151)), ("a", " ", at(60))], "doc_id string, question string, asked_at timestamp")
    got = {(r.question, r.asked_at): (r.ok, r.answer.split("• ")[-1]) for r in engine.ask_as_of(asked).collect()}
    assert got["text", at(10)] == (True, "first text") and got["text", at(60)] == (True, "second text")
    assert not got["text", at(151)][0] and not got[" ", at(60)][0]


def test_many_questions_of_one_document(spark):
    """More than travel together with one copy of the text."""
    from scriptorium.operators import search

    docs = spark.createDataFrame([("d", "\n".join(f"line{i} end" for i in range(300)))], "doc_id string, text string")
    asked = spark.createDataFrame([("d", f"line{i % 250} END", i) for i in range(500)] + [("d", "", 500), (None, "x", 501)], "doc_id string, question string, n int")
    got = {r.n: r.answer for r in search.ask(asked, docs).collect()}
    assert len(got) == 502
    for i in range(500):
        hits = [f"• line{k} end" for k in range(300) if f"line{i % 250}" in f"line{k}"][:8]
        assert got[i] == search.HEADING + "\n".join(hits)
    assert got[500] == search.NO_QUESTION and got[501] == search.NO_TEXT


def test_conflict_rules_in_a_database(spark):
    """The statements, run by another engine, do what the folds do."""
    import duckdb

    from scriptorium.sources import store

    ddl = "doc_id VARCHAR PRIMARY KEY, user_id VARCHAR, filename VARCHAR, size_bytes BIGINT, total_pages INT, updated_at INT"
    names = [c.split(" ")[0] for c in ddl.split(", ")]
    held, new = [("a", "u1", "x", 1, 2, 1), ("b", "u2", "y", 3, 4, 1)], [("a", "u3", "z", None, 9, 2), ("c", "u4", "w", 5, None, 2)]
    db = duckdb.connect()
    db.execute(f"CREATE TABLE documents ({ddl})")
    db.execute(f"CREATE TABLE staged ({ddl})")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?)", held)
    db.executemany("INSERT INTO staged VALUES (?, ?, ?, ?, ?, ?)", new)
    kinds = "doc_id string, user_id string, filename string, size_bytes long, total_pages int, updated_at int"
    folded = catalog.upsert_documents(spark.createDataFrame(held, kinds), spark.createDataFrame([(*r, 1) for r in new], kinds + ", seq long"))
    db.execute(store.conflict_sql("documents", "staged", names, "doc_id", [*catalog.MUTABLE, "updated_at"]))
    assert sorted(db.execute("SELECT * FROM documents").fetchall(), key=repr) == sorted((tuple(r) for r in folded.collect()), key=repr)
    db.execute(store.conflict_sql("staged", "documents", names, "doc_id"))
    assert sorted(db.execute("SELECT doc_id, user_id FROM staged").fetchall()) == [("a", "u3"), ("b", "u2"), ("c", "u4")]


def test_a_database_round_trip(spark):
    """Rows written to a database by JDBC and read again; the one that comes with Spark, in memory."""
    from scriptorium.sources import store

    url = "jdbc:derby:memory:round;create=true"
    rows = spark.createDataFrame([("a", 1, START), ("b", None, None)], "doc_id string, n int, at timestamp").repartition(2)
    store.write_database(rows, url, "kept")
    store.write_database(rows.limit(1), url, "kept")
    got = store.read_database(spark, url, "kept").toDF("doc_id", "n", "at")
    assert got.count() == 3 and {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(RuntimeError):
        store.write_database(rows, "", "kept")
