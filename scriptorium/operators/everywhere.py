"""Every question asked of every document, at the cost of what matches.

The distinct words of the questions are the patterns of one automaton, which reads each line once and names the words that it
holds; only questions whose rarest word is among these are looked at. A task keeps, for each question, the first places it has met, so
that at most a few rows for each question and task are shuffled, and the lines of the places that win are fetched at last.

Questions may be many: sets of words go into blocks of at most ``BLOCK_BYTES``, and each block is a pass over the texts. There is no
join of questions with documents.

Defined results: a question without a word of three signs is met by every line that is not blank; null texts and documents with a
null doc_id are not searched; places are ordered by doc_id, text and line; equal questions get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import query_words, raw_lines, strip
from scriptorium.operators.search import TOP
from scriptorium.scratch import broadcast_if_few, materialize

#: Bytes of the words of a block; its automaton takes some tens of times as much in each task.
BLOCK_BYTES = 4 << 20


class _Asked:
    """The questions of a block (sets of words), found by the words of a line."""

    def __init__(self, sets: list[tuple[int, tuple[str, ...]]]) -> None:
        self.automaton, self.by_word = ahocorasick.Automaton(), {}
        often: dict[str, int] = {}
        for _, words in sets:
            for w in words:
                often[w] = often.get(w, 0) + 1
        for number, words in sets:
            if words:
                key = min(words, key=lambda w: (often[w], -len(w), w))
                self.by_word.setdefault(key, []).append((number, frozenset(words) - {key}))
        for w in often:
            self.automaton.add_word(w, w)
        if often:
            self.automaton.make_automaton()
        self.any_line = [number for number, words in sets if not words]

    def met(self, low: str) -> Iterator[int]:
        """The questions that a lower-cased line meets."""
        if self.by_word:
            here = {w for _, w in self.automaton.iter(low)}
            for w in here & self.by_word.keys():
                for number, others in self.by_word[w]:
                    if others <= here:
                        yield number
        yield from self.any_line


def _first_places(docs: DataFrame, sets: list[tuple[int, tuple[str, ...]]], top: int) -> DataFrame:
    """(asked, doc_id, text_hash, line_no) of the first places of each question in each task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(sets)
        for batch in batches:
            places: dict[int, list] = {}
            ids, hashes, lows = (batch.column(c) for c in ("doc_id", "text_hash", "low"))
            order = pa.compute.rank(ids, tiebreaker="first").to_pylist()
            for k in sorted(range(batch.num_rows), key=order.__getitem__):
                for n, low in enumerate(lows[k].as_py()):
                    if not low or low.isspace():
                        continue
                    for number in asked.met(low):
                        held = places.setdefault(number, [])
                        place = (-order[k], -n, k)
                        if len(held) < top:
                            heappush(held, place)
                        elif place > held[0]:
                            heappushpop(held, place)
            rows = [(number, k, -n) for number, held in places.items() for _, n, k in held]
            at = pa.array([k for _, k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in rows], pa.int64()), ids.take(at), hashes.take(at), pa.array([n for _, _, n in rows], pa.int32())], names=["asked", "doc_id", "text_hash", "line_no"])

    low = F.transform(raw_lines(F.col("text")), lambda s: F.lower(s))
    source = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), low.alias("low"))
    return source.mapInArrow(run, f"asked long, doc_id {kind}, text_hash long, line_no int")


def ask_everywhere(questions: DataFrame, docs: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(the columns of questions, hit_no, doc_id, line): the first hits of each question (column question) in all documents."""
    words = F.array_sort(F.array_distinct(query_words(F.coalesce("question", F.lit("")))))
    asked = materialize(questions.withColumn("_words", words), "asked")
    sets = materialize(asked.select("_words").distinct().withColumn("_asked", F.monotonically_increasing_id()), "asked-sets")
    size = sets.agg(F.sum(F.octet_length(F.array_join("_words", " ")) + 8)).first()[0] or 0
    blocks = -(-size // block_bytes)
    docs = docs.select("doc_id", "text")

    found = []
    for b in range(blocks):
        mine = sets.where(F.pmod(F.xxhash64("_words"), F.lit(blocks)) == b).collect()  # about block_bytes of words
        first = _first_places(docs, [(r._asked, tuple(r._words)) for r in mine], top)
        found.append(first)
    if not found:
        none = docs.where("false").select(F.lit(0).cast("long").alias("asked"), "doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("line_no"))
        found = [none]
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    order = Window.partitionBy("asked").orderBy("doc_id", "text_hash", "line_no")
    # rows that share id and text are one place
    best = places.distinct().withColumn("hit_no", F.row_number().over(order)).where(F.col("hit_no") <= top)
    best = materialize(best, "asked-places")

    wanted = materialize(best.select("doc_id", "text_hash", "line_no").distinct(), "asked-lines")
    held = docs.where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    lines = held.join(broadcast_if_few(wanted), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "line_no", strip(F.get(raw_lines(F.col("text")), F.col("line_no"))).alias("line")).distinct()
    answered = best.join(lines, ["doc_id", "text_hash", "line_no"]).join(sets.withColumnRenamed("_asked", "asked"), "asked").select("_words", "hit_no", "doc_id", "line")
    return asked.join(answered.withColumnRenamed("doc_id", "_found"), "_words").select(*questions.columns, "hit_no", F.col("_found").alias("doc_id"), "line")
