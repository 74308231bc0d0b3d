import json
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import token_files

WORD = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, end=2):
    """(doc_id, start, n_tokens, checksum) by the library alone, text by text."""
    own = Tokenizer.from_file(WORD)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=300))
def test_packing_is_undone(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) // 64) * 8 * bits
    assert token_files.unpack(packed, bits)[: len(ids)].tolist() == ids.tolist()


def test_packing_is_the_bits_in_order():
    ids = np.arange(64, dtype=np.uint32) * 7 % 32
    whole = int.from_bytes(token_files.pack(ids, 5), "little")
    assert [whole >> 5 * k & 31 for k in range(64)] == ids.tolist()


def test_bits_and_ids_that_do_not_fit():
    assert [token_files.bits_for(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        token_files.pack(np.array([9], np.uint32), 3)
    with pytest.raises(ValueError):
        token_files.bits_for(0)


@pytest.fixture(scope="module")
def encoder():
    e = token_files.Encoder(WORD)
    assert e.by_word
    return e


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(WORD)


def same(encoder, own, texts):
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder(t.encode()) for t in texts] == want


def test_every_code_point_in_context(encoder, own):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        same(encoder, own, [f"Ab{c}cD {c} e{c} {c}9 '{c}s{c}" for c in points[at : at + 4096]])


def test_contractions_special_tokens_and_marks(encoder, own):
    same(encoder, own, ["don't I'LL'VE ''s \"'s x'", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <|", "école ́x É̀ ß ſ ﬁ Σς", "a b c\x1cd\x85e", "", " \n\t", "1234 ½ ²", "x" * 5000])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZéÉß'sdlLvVtrRm1²½ \n\t́ <|>endoftext&é-")), max_size=5))
def test_random_texts(encoder, own, texts):
    same(encoder, own, texts)


def test_what_is_remembered_is_bounded(own, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    e = token_files.Encoder(WORD)
    same(e, own, [f"a{k} b{k}c don't a{k} " + "y" * 300 for k in range(20)])
    assert len(e.words) <= 3 and len(e.words.cuts) <= 3


def test_what_is_asked_for_again_is_remembered(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 8)
    e, asked = token_files.Encoder(WORD), []
    tokenize = e.words.cuts.tokenize
    e.words.cuts.tokenize = lambda cut: asked.append(cut) or tokenize(cut)
    letters = "abcdefghij"
    for a in letters:
        for b in letters:
            e(f"river {a}{b}x".encode())
    assert asked.count("river") == 1 and len(asked) == 101


def test_texts_of_a_batch_together(own, monkeypatch):
    texts = ["the river the", None, "", " \n\t", "\x0bthe  river\r\n ", "don't Ab9 é ́x <|endoftext|> \x1cd", "the " * 3000, "x"]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    e, asked = token_files.Encoder(WORD), []
    get = e.words.made
    e.words.made = lambda word: asked.append(word) or get(word)
    for kind in (pa.string(), pa.large_string()):
        for part in (slice(0, 8), slice(1, 4), slice(4, 8), slice(0, 0)):
            ids, sizes = e.texts(pa.array(texts, kind)[part.start : part.stop])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == want[part]
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(token_files, "TEXT_BYTES", 20)
    batch = pa.record_batch({"doc_id": pa.array(range(8)), "text": pa.array(texts)})
    found = list(token_files._encoded(batch, e, 2))
    assert len(found) > 3 and [k for d, _, _ in found for k in d.to_pylist()] == list(range(8))
    assert [i for _, ids, _ in found for i in ids.tolist()] == [i for w in want for i in [*w, 2]] and [n for _, _, n in found for n in n.tolist()] == [len(w) + 1 for w in want]


def test_other_tokenizer_files_run_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = token_files.Encoder(path)
    assert not e.by_word
    same(e, Tokenizer.from_file(path), ["Some  words,\n\nand more", ""])


def written(docs, tmp_path, name="ids"):
    path = str(tmp_path / name)
    token_files.write(docs, path, WORD, 2)
    return path


@pytest.fixture
def many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_documents_come_back(spark, prose, tmp_path, many_files):
    rows = [(i * 37 % 500, prose(i % 90, i)) for i in range(500)] + [(1000, prose(60_000, 5))]
    path = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), tmp_path)
    got = token_files.read(spark, path).collect()
    want = expected(rows)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    told = token_files.manifest(path)
    assert told["bits"] == 16 and len(told["files"]) > 1 and told["n_ids"] == want[-1][1] + want[-1][2]
    held = sum(os.path.getsize(f"{path}/{f['file']}") for f in told["files"])
    assert held < 2 * told["n_ids"] + 40 * len(rows) + 4000 * len(told["files"])

    whole = np.concatenate([r.ids for r in sorted(got, key=lambda r: r.start)])
    rng = random.Random(3)
    for _ in range(50):
        a, n = rng.randrange(len(whole)), rng.randrange(3000)
        assert token_files.ids_at(path, a, n).tolist() == whole[a : a + n].tolist()
    assert token_files.ids_at(path, len(whole) + 5, 3).tolist() == []


def test_reading_fewer_columns(spark, tmp_path):
    path = written(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tmp_path)
    assert token_files.read(spark, path, ("n_tokens", "doc_id")).collect() == [(3, 1)]


def test_a_file_of_many_splits(spark, prose, tmp_path, monkeypatch):
    rows = [(i, prose(20, i)) for i in range(300)]
    path = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tmp_path)
    monkeypatch.setattr(token_files, "SPLIT", 500)
    monkeypatch.setattr(token_files, "RUN", 100)
    reader = token_files._Reader(path, token_files.PackedIds({"path": path, "columns": "doc_id,start,n_tokens,ids_crc32"}).schema())
    splits = reader.partitions()
    assert len(splits) > 10
    got = [tuple(r.values()) for s in splits for b in reader.read(s) for r in b.to_pylist()]
    assert got == expected(rows)


def test_only_committed_files_count_and_damage_shows(spark, tmp_path):
    path = written(spark.createDataFrame([(i, "some words here " * 9) for i in range(40)], "doc_id long, text string").coalesce(1), tmp_path)
    before = token_files.read(spark, path).collect()
    with open(f"{path}/part-00000-lost.ids", "wb") as f:  # of an attempt that never came to its end
        f.write(token_files.MAGIC + b"half a file")
    assert token_files.read(spark, path).collect() == before
    name = f"{path}/{token_files.manifest(path)['files'][0]['file']}"
    with open(name, "r+b") as f:
        f.seek(50)
        f.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        token_files.read(spark, path).collect()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path, many_files):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = token_files.read(spark, written(odd_docs, tmp_path)).collect()
    assert sorted(((r.n_tokens, r.ids_crc32) for r in got)) == sorted((n, c) for _, _, n, c in expected(rows))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    empty = token_files.read(spark, written(no_docs, tmp_path, "none"))
    assert empty.collect() == [] and empty.columns == list(token_files.COLUMNS)


def test_ids_that_exist_already(spark, tmp_path):
    path = str(tmp_path / "given")
    token_files.register(spark)
    rows = spark.createDataFrame([(1, [5, 0, 99]), (2, []), (3, None), (4, [7])], "doc_id long, ids array<int>").coalesce(1)
    rows.write.format(token_files.FORMAT).options(path=path, vocabulary=100).mode("append").save()
    assert token_files.manifest(path)["bits"] == 7
    got = token_files.read(spark, path, ("doc_id", "start", "ids")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, [5, 0, 99]), (2, 3, []), (3, 3, []), (4, 3, [7])]


def test_ids_of_documents_may_be_strings(spark, tmp_path):
    path = written(spark.createDataFrame([("b", "x"), ("a", "y y")], "doc_id string, text string"), tmp_path)
    assert [(r.doc_id, r.start) for r in token_files.read(spark, path).orderBy("start").collect()] == [("a", 0), ("b", 3)]
    assert json.loads(json.dumps(token_files.manifest(path)))["vocabulary"] == 49408
