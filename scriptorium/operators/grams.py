"""A substring index: which documents hold three signs in a row, for searches that need not read every text.

A gram is three code points of the lower-cased text, none of them white space (words hold none), packed into a long. Tasks
number the documents that they read in segments of at most ``SEGMENT`` and write, for each gram of a segment, the numbers of its
documents. So no posting is shuffled by itself, and no list has more than a segment's entries however common its gram is. The lists lie in
folders by a hash of the gram, sorted by gram, so that a search reads the folders, and in these the pages, of its own grams
alone. A search intersects the rarest of its lists segment by segment and tests the lines of what is left exactly.

Defined results: every word of a search has three signs or more, so it has a gram; a search without words is met by
every line and reads all texts; null texts hold nothing; rows with a null doc_id cannot be named by an index and are left out; rows that
share a doc_id are found together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import search
from scriptorium.scratch import broadcast_if_few, materialize, new_folder, text_batches

WIDTH = 3
SEGMENT = 4096
#: Postings after which a segment ends, also if it has fewer documents.
POSTINGS = 2_000_000
BUCKETS = 64
#: The bucket of the rows that say which documents a segment's numbers are.
NUMBERS = -1
#: The rarest lists that are intersected, and the candidates that are named in the scan's own filter.
RAREST = 4
NAMED = 1000

#: The code points of white space, by the rule of the search itself.
_BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.int64)


def grams_of(text: str) -> np.ndarray:
    """The distinct grams of a lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < WIDTH:
        return np.empty(0, np.int64)
    blank = np.isin(points, _BLANK)
    whole = ~(blank[:-2] | blank[1:-1] | blank[2:])
    return np.unique((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[whole])


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(buckets)).astype(np.int32)


def _segment(ids: pa.Array, found: list[np.ndarray], part: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The lists of a segment, and its documents' ids."""
    names = ["bucket", "part", "gram", "n", "numbers", "ids"]
    numbers = np.repeat(np.arange(len(found), dtype=np.int16), [len(g) for g in found])
    grams = np.concatenate(found) if found else np.empty(0, np.int64)
    order = np.argsort(grams, kind="stable")
    grams, numbers = grams[order], numbers[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
    distinct, borders = grams[starts], np.r_[starts, len(grams)].astype(np.int32)
    for at in range(0, len(distinct), 20_000):
        some = slice(at, min(at + 20_000, len(distinct)))
        k = some.stop - some.start
        low, high = borders[some.start], borders[some.stop]
        lists = pa.ListArray.from_arrays(pa.array(borders[some.start : some.stop + 1] - low), pa.array(numbers[low:high]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket_of(distinct[some], buckets)), pa.array(np.full(k, part)), pa.array(distinct[some]), pa.array(np.diff(borders[some.start : some.stop + 1]).astype(np.int32)), lists, pa.nulls(k, pa.list_(ids.type))], names=names
        )
    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([pa.array([NUMBERS], pa.int32()), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int32()), pa.nulls(1, pa.list_(pa.int16())), own], names=names)


class GramIndex:
    """The index under a folder; it is added to, never rewritten."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def add(self, docs: DataFrame) -> None:
        """Index documents (doc_id, text): one pass over the texts, one shuffle of whole lists."""
        buckets, base = self.buckets, uuid.uuid4().int >> 66
        source = docs.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("low"))
        kind = source.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, ids, found, held = base + (TaskContext.get().partitionId() << 24), [], [], 0
            for batch in batches:
                for k, low in enumerate(batch.column("low")):
                    ids.append(batch.column("doc_id").slice(k, 1))
                    found.append(grams_of(low.as_py()))
                    held += len(found[-1])
                    if len(ids) == SEGMENT or held >= POSTINGS:
                        yield from _segment(pa.concat_arrays(ids), found, part, buckets)
                        part, ids, found, held = part + 1, [], [], 0
            if ids:
                yield from _segment(pa.concat_arrays(ids), found, part, buckets)

        lists = source.mapInArrow(run, f"bucket int, part long, gram long, n int, numbers array<smallint>, ids array<{kind}>")
        # lists of one bucket may be split over several files, so that a common gram is nobody's burden
        with text_batches(self.spark):
            lists.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "gram", "part").write.mode("append").partitionBy("bucket").parquet(self.path)

    def _lists(self, grams: list[int]) -> DataFrame:
        there = sorted(set(bucket_of(np.array(grams, np.int64), self.buckets).tolist()))
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(there) & F.col("gram").isin(grams))

    def rarest(self, words: list[str]) -> list[int] | None:
        """The rarest grams of the words; none where some gram is in no document."""
        grams = np.unique(np.concatenate([grams_of(w) for w in words])).tolist()
        counts = {r.gram: r.n for r in self._lists(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row per gram of the words
        return sorted(grams, key=lambda g: (counts[g], g))[:RAREST] if len(counts) == len(grams) else None

    def candidates(self, words: list[str]) -> DataFrame:
        """(doc_id) of the documents that hold the rarest grams of all the words."""
        table = self.spark.read.parquet(self.path)
        numbers = table.where(F.col("bucket") == NUMBERS).select("part", "ids")
        wanted = self.rarest(words)
        if wanted is None:
            return numbers.where("false").select(F.explode("ids").alias("doc_id"))
        # at most RAREST lists of at most SEGMENT numbers meet in a group
        met = self._lists(wanted).groupBy("part").agg(F.collect_list("numbers").alias("lists")).where(F.size("lists") == len(wanted))
        common = F.aggregate(F.slice("lists", 2, RAREST), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        met = met.select("part", common.alias("common")).where(F.size("common") > 0)
        return met.join(numbers, "part").select(F.explode(F.transform("common", lambda k: F.get("ids", k.cast("int")))).alias("doc_id"))

    def search_lines(self, docs: DataFrame, question: str, top: int = search.TOP) -> DataFrame:
        """The same rows as the search of all texts, from the texts of candidates alone."""
        words = search.words_of(question)
        if not words:
            return search.search_lines(docs, question, top)
        found = materialize(self.candidates(words).distinct(), "gram-candidates")
        n = found.count()
        if n <= NAMED:
            return search.search_lines(docs.where(F.col("doc_id").isin([r.doc_id for r in found.collect()])), question, top)  # at most NAMED rows
        return search.search_lines(docs.join(broadcast_if_few(found), "doc_id", "left_semi"), question, top)


def indexed(docs: DataFrame, buckets: int = BUCKETS) -> GramIndex:
    """An index of the documents in a folder of its own."""
    index = GramIndex(docs.sparkSession, new_folder(docs.sparkSession, "grams"), buckets)
    index.add(docs)
    return index

