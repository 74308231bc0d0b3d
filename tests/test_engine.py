"""Sources, store, catalog and the engine."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.engine import Engine
from scriptorium.operators import catalog, chunks, retention
from scriptorium.sources import extract, store, uploads
from scriptorium.streaming.ingest import first_puts, ingest_files, uploads_per_window


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "sample.txt").write_text("hello world\nthis is a test")
    (d / "latin.csv").write_bytes("käse,1".encode("latin-1"))
    (d / "note.docx").write_bytes(docx("first line", "second line"))
    (d / "broken.docx").write_bytes(b"no zip")
    (d / "paper.pdf").write_bytes(b"%PDF")
    (d / "malware.exe").write_bytes(b"MZ")
    (d / "noname").write_bytes(b"x")
    return d


def test_files(spark, folder):
    accepted, rejected = uploads.read_files(spark, str(folder))
    text = {r.filename: r.text for r in accepted.collect()}
    assert text["sample.txt"] == "hello world\nthis is a test"
    assert text["latin.csv"] == "käse,1"
    assert text["note.docx"] == "first line\nsecond line"
    assert text["broken.docx"].startswith(extract.DOCX_ERROR)
    assert text["paper.pdf"]
    assert {r.filename: r.error for r in rejected.collect()} == {"malware.exe": "unsupported file type: exe", "noname": "unsupported file type: "}
    _, rejected = uploads.read_files(spark, str(folder), limit=3)
    assert "sample.txt" in {r.filename for r in rejected.where("error = 'file too large'").collect()}


def test_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"user_id":"u","text":"hi"}\n{"filename":"x.md","text":"yo"}\n{"filename":"empty","text":""}\n')
    accepted, rejected = uploads.read_json(spark, str(tmp_path))
    assert {r.filename: r.text for r in accepted.collect()} == {"payload.txt": "hi", "x.md": "yo"}
    assert [tuple(r) for r in rejected.collect()] == [("empty", uploads.NO_INPUT)]


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    accepted, _ = uploads.read_files(spark, str(folder))
    ids = {r.filename: r.doc_id for r in engine.ingest(accepted).collect()}
    assert len(ids) == 5
    asked = spark.createDataFrame([(ids["sample.txt"], "world"), (ids["note.docx"], "nothing"), ("absent", "x")], "doc_id string, question string")
    got = {r.doc_id: (r.ok, r.answer) for r in engine.ask(asked).collect()}
    assert got[ids["sample.txt"]][1].endswith("• hello world")
    assert "couldn't find" in got[ids["note.docx"]][1]
    assert got["absent"][0] is False
    assert engine.lookup(ids["latin.csv"]).first().size_bytes == len("käse,1".encode())
    engine.set_status(ids["sample.txt"], "indexed")
    engine.set_status("absent", "indexed")
    assert engine.catalog().where("status = 'indexed'").count() == 1
    assert engine.chunks.read().count() == 5
    assert engine.health().first().ok
    engine.reset(asked)
    assert engine.preview(asked).where("preview != ''").count() == 0
    requests = spark.createDataFrame([("", ids["latin.csv"], "s"), (None, None, None)], "path_id string, query_id string, session_id string")
    assert sorted(r.preview for r in engine.chat(requests).collect()) == ["", "käse,1"]
    engine.map_embeddings(spark.createDataFrame([("c", 1)], "chunk_id string, vector_index int"))
    assert engine.embeddings_map.read().count() == 1


def test_stream(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    for more in (None, "late.md"):
        if more:
            (folder / more).write_text("late")
        ingest_files(spark, engine, str(folder), str(tmp_path / "mark")).awaitTermination(120)
    assert engine.documents.read().count() == 6


def test_stream_state(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "doc_id string, t string").selectExpr("doc_id", "cast(t as timestamp) stored_at").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("doc_id string, stored_at timestamp").parquet(str(tmp_path / "p"))
    q = first_puts(stream, 60).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 2
    events = stream.select(F.col("stored_at").alias("ts"), F.col("doc_id").alias("event_type"))
    q = uploads_per_window(events).writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_type: r["count"] for r in spark.table("counts").collect()} == {"a": 2, "b": 1}


def test_upsert_keeps_and_updates(spark):
    ddl = "doc_id string, user_id string, filename string, total_pages int, created_at int, updated_at int"
    old = spark.createDataFrame([("d", "u1", "a", 3, 1, 1)], ddl)
    new = spark.createDataFrame([("d", "u2", "b", None, 2, 2, 5), ("d", "u3", "c", None, 3, 3, 6), ("e", None, "x", 1, 3, 3, 7), ("e", "u", "y", None, 4, 4, 8)], ddl + ", seq long")
    assert {tuple(r) for r in catalog.upsert_documents(old, new).collect()} == {("d", "u1", "c", None, 1, 3), ("e", None, "y", None, 3, 4)}


def test_insert_absent(spark):
    rows = spark.createDataFrame([("c", 1, 0), ("c", 2, 1), ("known", 3, 2)], "chunk_id string, v int, seq int")
    assert [tuple(r) for r in catalog.insert_absent(spark.createDataFrame([("known",)], "chunk_id string"), rows).collect()] == [("c", 1)]


def test_age_limit(spark):
    at = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(at - datetime.timedelta(seconds=s),) for s in (0, 86400, 86401)], "t timestamp")
    assert [r[0] for r in rows.select(retention.alive(F.col("t"), F.lit(at))).collect()] == [True, True, False]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "é" * 10), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    parts = chunks.split_chunks(docs, 7)
    assert sorted((r.doc_id, r.chunk_index, r.end_offset) for r in parts.collect()) == [(1, 0, 7), (1, 1, 14), (1, 2, 20), (4, 0, 3)]
    expected = docs.select("doc_id", chunks.chunk_count(F.octet_length("text"), 7).alias("chunks"))
    assert {r.doc_id: r.text for r in chunks.join_chunks(parts, expected).collect()} == {1: "é" * 10, 2: "", 3: "", 4: "abc"}
    meta = {r.doc_id: (r.storage_key, r.stored_bytes, r.token_count) for r in chunks.chunk_rows(docs, 7, 100).collect()}
    assert meta == {1: ("doc:1", 20, 1), 4: ("doc:4", 3, 1)}


def test_database_url():
    assert store.database_url("h", "u", "p@ss", "d") == "jdbc:postgresql://h:5432/d?user=u&password=p%40ss"
    assert store.database_url("", "u", "p", "d") == ""
    with pytest.raises(RuntimeError):
        store.read_database(None, "", "t")


def test_tables(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    assert store.tables(spark).where("name = 'some_view' and is_temporary").count() == 1
