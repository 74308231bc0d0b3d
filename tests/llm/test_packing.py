import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptorium.llm import packing
from scriptorium.llm.common import materialize

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(count, length):
    """The least number of sequences, by exhaustive search over small histograms."""
    sizes = tuple(sorted(count, reverse=True))

    @lru_cache(None)
    def solve(left):
        k = next((i for i, n in enumerate(left) if n), None)
        if k is None:
            return 0
        best = None

        def fill(i, room, now):
            nonlocal best
            if i == len(sizes):
                n = 1 + solve(now)
                best = n if best is None else min(best, n)
                return
            for take in range(min(now[i], room // sizes[i]), -1, -1):
                fill(i + 1, room - take * sizes[i], (*now[:i], now[i] - take, *now[i + 1 :]))

        fill(k, length - sizes[k], (*left[:k], left[k] - 1, *left[k + 1 :]))
        return best

    return solve(tuple(count[s] for s in sizes))


def check_plan(plan, count, length):
    used = Counter()
    for f in plan:
        assert sum(f.lengths) <= length
        assert f.times > 0
        for s in f.lengths:
            used[s] += f.times
    assert used == Counter({s: n for s, n in count.items() if n})
    return sum(f.times for f in plan)


def test_bin_completion_against_exhaustive_search():
    rng = random.Random(2)
    for _ in range(40):
        length = rng.choice([10, 12, 20])
        count = dict(Counter(rng.randrange(1, length + 1) for _ in range(rng.randrange(1, 9))))
        best = check_plan(packing.best_fit(count, length), count, length)
        found = check_plan(packing.complete_bins(count, length), count, length)
        assert fewest(count, length) <= found <= best
        assert found == fewest(count, length)


def test_never_worse_than_best_fit():
    rng = random.Random(6)
    for n in (50, 500, 5000):
        count = dict(Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(n)))
        best = check_plan(packing.best_fit(count, 1024), count, 1024)
        found = check_plan(packing.complete_bins(count, 1024, nodes=300), count, 1024)
        assert found <= best
    assert packing.complete_bins({}, 1024) == []


def test_fillings_are_undominated():
    left = {7: 1, 5: 1, 4: 2, 3: 1, 2: 1}
    found = packing.fillings(7, left, 12, 12, 1000)
    assert (5,) in found
    assert (4,) not in found  # 5 could stand in its place
    assert all(sum(f) <= 5 for f in found)


def test_piece_bounds():
    assert packing.piece_bounds(1, 4) == [(0, 1)]
    assert packing.piece_bounds(4, 4) == [(0, 4)]
    assert packing.piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_same_ids_as_the_tokenizer():
    own, given = packing.encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    pieces = ["word", " ", "  ", "\n", "don't", "123", "é", "漢字", "\U0001f600", "<|endoftext|>", "<|end", "###", "\t", " ", "ÀB", "_"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", "a" * 3000]
    for t in texts:
        assert own(t) == given.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "a", "#", "\u3000", "x" * 300 + " "])
def test_very_long_texts(unit):
    text = "begin " + unit * (1_200_000 // len(unit)) + " end"
    assert packing.encoder(PATH)(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_very_long_white_space_in_spark(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "\n" * 30_000 + "x"), (3, "word")], "doc_id long, text string")
    rows = packing.pack_documents(spark, docs, PATH).collect()
    check_layout(rows, 1024)
    assert {r.doc_id for r in rows} == {1, 2, 3}


@pytest.mark.parametrize("length", [64, 1024])
def test_round_trip(spark, prose, odd_docs, length):
    rng = random.Random(3)
    docs = [(i, prose(rng.choice([0, 1, 5, 30, 60, 700]), i)) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text").selectExpr("doc_id + 1000 as doc_id", "text"))
    rows = packing.pack_documents(spark, frame, PATH, length).collect()
    check_layout(rows, length)
    tokenizer = Tokenizer.from_file(PATH)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for i, t in docs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == length or k == 0
            at += r.length
        assert at == len(ids)
    assert sum(1 for r in rows if r.doc_id in (1002, 1003)) == 2  # no text: the end token alone
    assert all(r.length == 1 for r in rows if r.doc_id in (1002, 1003))


def check_layout(rows, length):
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append(r)
    for group in of.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length


def test_one_length_holds_most_rows(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, id % 64 + 1, 20) as length", "id as ids_crc32")
    check_layout(packing.pack(materialize(rows, "test"), 64).collect(), 64)


def test_empty(spark, no_docs):
    assert packing.pack_documents(spark, no_docs, PATH).count() == 0
