"""Puts, renewals and expiries of a stream, and its sessions, held against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import registry
from scriptorium.streaming import expiry

TTL = 100
EPOCH = datetime.datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


def expected(puts, mark):
    """What happened to each key, as far as the mark (in seconds)."""
    out = []
    for key in {k for k, _ in puts}:
        last = None
        for t in sorted(t for k, t in puts if k == key):
            if last is not None and t - last > TTL:
                out.append((key, last + TTL, "expired"))
                last = None
            out.append((key, t, "renewed" if last is not None else "put"))
            last = t
        if int((last + TTL) * 1000) + 1 <= mark * 1000:
            out.append((key, last + TTL, "expired"))
    return sorted(out)


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", expiry.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def seconds(rows):
    return sorted((r.doc_id, round((r.at - EPOCH).total_seconds(), 3), r.what) for r in rows)


def test_lifetimes_over_restarts(spark, tmp_path, state_store):
    rng = random.Random(1)
    puts = sorted((("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(20_000) / 4) for _ in range(600)), key=lambda p: p[1])
    # exactly at the end of its time a text still lives, and is renewed
    puts += [("edge", 5100.0), ("edge", 5200.0), ("edge", 5300.25), ("mark", 6000.0)]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (puts[:200], puts[200:420], puts[420:]):
        rows = [(k, at(t)) for k, t in part] + [(None, at(part[0][1])), ("null", None)]
        spark.createDataFrame(rows, "doc_id string, stored_at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id string, stored_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        found = expiry.run_to_end(expiry.lifetimes(stream, TTL, "10 seconds"), out, mark)
    assert seconds(found.collect()) == expected(puts, 6000 - 10)
    assert ("edge", 5200.0, "renewed") in seconds(found.collect()) and ("edge", 5300.0, "expired") in seconds(found.collect())


def test_a_late_put_renews_nothing(spark, tmp_path, state_store):
    source = str(tmp_path / "in")
    for part in ([("a", 1000)], [("a", 995), ("b", 1000)], [("z", 2000)]):
        spark.createDataFrame([(k, at(t)) for k, t in part], "doc_id string, stored_at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id string, stored_at timestamp").parquet(source)
        found = expiry.run_to_end(expiry.lifetimes(stream, TTL, "10 seconds"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert seconds(found.collect()) == [("a", 995, "renewed"), ("a", 1000, "put"), ("a", 1100, "expired"), ("b", 1000, "put"), ("b", 1100, "expired"), ("z", 2000, "put")]


def test_sessions_of_a_batch_and_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    events = sorted((rng.choice("abc"), rng.randrange(40_000)) for _ in range(300)) + [("d", 10), ("d", 1810), ("d", 3611), ("e", 90_000)]
    want = []
    for key in "abcde":
        run = []
        for t in sorted(t for k, t in events if k == key):
            if run and t - run[-1] > 1800:
                want.append((key, run[0], run[-1] + 1800, len(run)))
                run = []
            run.append(t)
        want.append((key, run[0], run[-1] + 1800, len(run)))
    rows = [(k, at(t)) for k, t in events] + [(None, at(1)), ("a", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    read = lambda found: sorted((r.k, (r.start - EPOCH).total_seconds(), (r.end - EPOCH).total_seconds(), r.n) for r in found.collect())
    assert read(expiry.sessions(df, "k", "ts")) == sorted(want)
    ordered = df.orderBy("ts")
    for low, high in ((-1, 20_000), (20_000, 100_000)):
        ordered.where((F.col("ts") >= F.lit(at(low))) & (F.col("ts") < F.lit(at(high)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed = read(expiry.run_to_end(expiry.sessions(stream, "k", "ts"), str(tmp_path / "out"), str(tmp_path / "mark")))
    assert closed == sorted(w for w in want if w[2] <= 90_000 - 600)


def test_parts_of_the_query_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).selectExpr("id % 40 as user_id", "timestamp_seconds(1704067200 + id * 60) as ts")
    rows.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(registry, "new_folder", lambda *_: str(tmp_path / "stream"))
    try:
        found = registry.stream_expiry(spark, str(tmp_path))
        assert len(list((tmp_path / "stream" / "in").glob("part-*.parquet"))) >= 6
        assert found.where("what <> 'expired'").count() == 6000
        assert {(r.doc_id, r.at_us, r.what) for r in found.collect() if r.doc_id == 7} >= {(7, 1704067200000000 + 7 * 60_000_000, "put"), (7, 1704067200000000 + 47 * 60_000_000, "renewed")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
