"""Ranking by relevance (BM25) over an index that prunes by block maxima.

Terms are runs of letters and digits of the lower-cased text. Tasks number the documents that they read in blocks and write, for each
term of a block, its documents and how often they hold it, with the largest such number and the shortest such document: a bound
for what any document of the block can score, whatever the averages of the corpus are when it is asked for. A question reads these bounds first;
it scores the blocks of the highest ones, and then only those others whose bound reaches the worst score that it has by then.

Defined results: documents without any term of the question have no rank; a term counts once however often the question says
it; equal scores are ranked by doc_id; null texts are empty documents; rows with a null doc_id are not indexed; rows that share a doc_id are
ranked each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.scratch import broadcast_if_few, new_folder, text_batches

TERM = r"[\p{L}\p{N}]+"
#: The usual parameters of the ranking.
K1, B = 1.2, 0.75
BLOCK = 4096
#: Postings after which a block ends, also if it has fewer documents.
POSTINGS = 1_000_000
BUCKETS = 64
NUMBERS = -1
#: Blocks that are scored first, to have a score that the others' bounds must reach.
FIRST = 8


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


class _Block:
    """Documents of a block, and their terms with how often each holds them."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.numbers, self.times, self.terms = [], [], [], [], []
        self.n = self.postings = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, numbers: np.ndarray, times: np.ndarray, terms: pa.Array) -> None:
        """Documents, and postings whose numbers count from the first of these."""
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.numbers.append(numbers + self.n)
        self.times.append(times)
        self.terms.append(terms)
        self.n, self.postings = self.n + len(ids), self.postings + len(numbers)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        names = ["part", "term", "n", "numbers", "times", "most", "least", "ids", "lengths"]
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths).astype(np.int32)
        coded = pa.chunked_array(self.terms, pa.string()).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        numbers, times = np.concatenate(self.numbers)[order], np.concatenate(self.times)[order].astype(np.int32)
        starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for at in range(0, len(coded.dictionary), 20_000):
            some = starts[at : at + 20_001]
            low, high, k = some[0], some[-1], len(some) - 1
            borders = pa.array((some - low).astype(np.int32))
            columns = [pa.array(np.full(k, part)), coded.dictionary.slice(at, k), pa.array(np.diff(some).astype(np.int32)), pa.ListArray.from_arrays(borders, pa.array(numbers[low:high].astype(np.int16))),
                       pa.ListArray.from_arrays(borders, pa.array(times[low:high])), pa.array(np.maximum.reduceat(times[low:high], some[:-1] - low)),
                       pa.array(np.minimum.reduceat(lengths[numbers[low:high]], some[:-1] - low)), pa.nulls(k, pa.list_(ids.type)), pa.nulls(k, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        none = [pa.nulls(1, k) for k in (pa.list_(pa.int16()), pa.list_(pa.int32()), pa.int32(), pa.int32())]
        own = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(lengths))]
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int32()), *none, *own], names=names)


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(lengths, documents, times, terms): each term of each document of a batch once, documents in order."""
    lists = batch.column("terms")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    many = max(1, len(coded.dictionary))
    keys = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * many + coded.indices.to_numpy(zero_copy_only=False)
    found, times = np.unique(keys, return_counts=True)
    return lengths, found // many, times, coded.dictionary.take(pa.array(found % many))


class RankIndex:
    """The index under a folder; it is added to, never rewritten."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, term: Column) -> Column:
        return F.when(term.isNull(), NUMBERS).otherwise(F.pmod(F.xxhash64(term), F.lit(self.buckets))).cast("int")

    def add(self, docs: DataFrame) -> None:
        """Index documents (doc_id, text): one pass over the texts, one shuffle of whole lists."""
        base = uuid.uuid4().int >> 66
        source = docs.where("doc_id is not null").select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("terms"))
        kind = source.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, block = base + (TaskContext.get().partitionId() << 24), _Block()
            for batch in batches:
                lengths, documents, times, found = _counted(batch)
                ends, at = np.searchsorted(documents, np.arange(batch.num_rows + 1)), 0
                while at < batch.num_rows:
                    # as many documents as the block has room for, at least one
                    room = int(np.searchsorted(ends, ends[at] + max(0, POSTINGS - block.postings), "right")) - 1
                    stop = min(batch.num_rows, at + BLOCK - block.n, max(at + 1, room))
                    low, high = ends[at], ends[stop]
                    block.add(batch.column("doc_id").slice(at, stop - at), lengths[at:stop], documents[low:high] - at, times[low:high], found.slice(low, high - low))
                    if block.n == BLOCK or block.postings >= POSTINGS or stop < batch.num_rows:
                        yield from block.rows(part)
                        part, block = part + 1, _Block()
                    at = stop
            if block.n:
                yield from block.rows(part)

        lists = source.mapInArrow(run, f"part long, term string, n int, numbers array<smallint>, times array<int>, most int, least int, ids array<{kind}>, lengths array<int>")
        dealt = lists.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", F.col("bucket"))
        with text_batches(self.spark):
            dealt.sortWithinPartitions("bucket", "term", "part").write.mode("append").partitionBy("bucket").parquet(self.path)

    def search(self, question: str, top: int) -> DataFrame:
        """(rank, doc_id, score) of the best documents for a question."""
        table = self.spark.read.parquet(self.path)
        blocks = table.where(F.col("bucket") == NUMBERS)
        total = blocks.agg(F.sum("n").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
        asked = self.spark.createDataFrame([(question,)], "q string").select(F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
        known = {r.term: r.bucket for r in asked.withColumn("bucket", self._bucket(F.col("term"))).collect()}  # the terms of a question
        lists = table.where(F.col("bucket").isin(sorted(set(known.values()))) & F.col("term").isin(sorted(known)))
        counts = {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        ddl = f"rank int, doc_id {table.schema['ids'].dataType.elementType.simpleString()}, score double"
        if not counts:
            return self.spark.createDataFrame([], ddl)
        mean = total.words / total.n
        weight = self.spark.createDataFrame([(t, log(1 + (total.n - n + 0.5) / (n + 0.5))) for t, n in counts.items()], "term string, weight double")
        lists = lists.join(F.broadcast(weight), "term")  # a row for each term of the question

        def scored(times: Column, length: Column) -> Column:
            return F.col("weight") * times * (K1 + 1) / (times + K1 * (1 - B + B * length / mean))

        bounds = lists.groupBy("part").agg(F.sum(scored(F.col("most"), F.col("least"))).alias("bound"))

        def best(parts: DataFrame) -> DataFrame:
            """The top of the documents of some blocks."""
            held = lists.join(broadcast_if_few(parts.select("part")), "part", "left_semi").join(blocks.select("part", F.col("ids").alias("_ids"), F.col("lengths").alias("_lengths")), "part")
            each = held.select("part", "weight", "_ids", "_lengths", F.explode(F.arrays_zip("numbers", "times")).alias("p"))
            number = F.col("p.numbers").cast("int")
            points = each.select("part", number.alias("number"), F.get("_ids", number).alias("doc_id"), scored(F.col("p.times"), F.get("_lengths", number)).alias("points"))
            sums = points.groupBy("part", "number", "doc_id").agg(F.sum("points").alias("score"))
            return sums.orderBy(F.desc("score"), "doc_id").limit(top).select("doc_id", "score")

        first = bounds.orderBy(F.desc("bound"), "part").limit(FIRST).collect()
        found = best(self.spark.createDataFrame([(r.part, r.bound) for r in first], "part long, bound double")).collect()  # the top
        # a bound is a sum of the same numbers as a score, but perhaps in another order
        least = min(r.score for r in found) * (1 - 1e-9) if len(found) == top else 0.0
        rest = bounds.where((F.col("bound") >= least) & ~F.col("part").isin([r.part for r in first]))
        kept = self.spark.createDataFrame([tuple(r) for r in found], ddl.replace("rank int, ", "")).unionByName(best(rest))
        rows = kept.orderBy(F.desc("score"), "doc_id").limit(top).collect()
        return self.spark.createDataFrame([(k, r.doc_id, r.score) for k, r in enumerate(rows, 1)], ddl)


def indexed(docs: DataFrame, buckets: int = BUCKETS) -> RankIndex:
    """An index of the documents in a folder of its own."""
    index = RankIndex(docs.sparkSession, new_folder(docs.sparkSession, "ranks"), buckets)
    index.add(docs)
    return index
