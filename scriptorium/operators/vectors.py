"""Nearest vectors by cosine, over lists of a coarse quantizer, and the chunks to which the vectors belong.

Centres are made on a bounded sample (``SAMPLE`` rows, those of the least hash of their number); every row of the table is put into the list
of its nearest centre. A search probes the lists whose centres are nearest to a question and ranks their rows exactly; probing all lists is the
exact search. Questions go to the tasks in blocks of ``QUESTIONS``, each a pass over the probed lists; a task keeps the best of each
question, so that no list, however long, is one task's work, and few rows are shuffled.

Defined results: vectors that are null or empty, hold a null or a value that is not finite, have no length (all zeros), or another length than
most, are neither found nor ask; a vector does not find itself, but finds its equals; equal scores (to nine decimals) are ranked by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.scratch import new_folder

LISTS, SAMPLE, ROUNDS = 64, 16_384, 12
#: Lists that a search probes where it need not be exact.
PROBES = 40
QUESTIONS = 4096
DECIMALS = 9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit array<double>) of the vectors that have a direction."""
    wide = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 1e150))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False))).select("vec_id", wide.alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("norm > 0")
    return rows.select("vec_id", F.transform("v", lambda x: F.try_divide(x, F.col("norm"))).alias("unit"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centres_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (unit vectors) of a sample; fewer where it has fewer distinct rows."""
    distinct = np.unique(sample, axis=0)
    if len(distinct) <= lists:
        return distinct
    centres = distinct[np.random.default_rng(5).choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


class VectorIndex:
    """Vectors by list under a folder."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, kind: str) -> None:
        self.spark, self.path, self.centres, self.kind = spark, path, centres, kind

    @classmethod
    def build(cls, vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> VectorIndex:
        spark, rows = vectors.sparkSession, usable(vectors)
        kind = rows.schema["vec_id"].dataType.simpleString()
        widths = rows.groupBy(F.size("unit").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        if widths is None:
            return cls(spark, "", np.empty((0, 0)), kind)
        rows = rows.where(F.size("unit") == widths.width)
        taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("unit").collect()  # the sample
        centres = centres_of(np.array([r.unit for r in taken]), lists)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = (_matrix(batch.column("unit"), centres.shape[1]) @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["vec_id", "unit", "list"])

        path = new_folder(spark, "vectors")
        rows.mapInArrow(run, f"vec_id {kind}, unit array<double>, list int").hint("rebalance", F.col("list")).write.partitionBy("list").parquet(path)
        return cls(spark, path, centres, kind)

    def search(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(asked, rank, vec_id, score): the k nearest of each question (vec_id, embedding); all lists are probed if no number is given."""
        ddl = f"asked {self.kind}, vec_id {self.kind}, score double"
        width, probes = self.centres.shape[1], min(probes or len(self.centres), len(self.centres))
        asked = usable(questions).where(F.size("unit") == width) if len(self.centres) else usable(questions).where("false")
        blocks = -(-asked.count() // QUESTIONS)
        found = self.spark.createDataFrame([], ddl)
        for b in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("vec_id", "unit"), F.lit(blocks)) == b).collect()  # about QUESTIONS
            if rows:
                found = found.unionByName(self._block([r.vec_id for r in rows], np.array([r.unit for r in rows]), k, probes, ddl))
        order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "rank", "vec_id", "score")

    def _block(self, ids: list, units: np.ndarray, k: int, probes: int, ddl: str) -> DataFrame:
        near = np.argsort(-(units @ self.centres.T), axis=1, kind="stable")[:, :probes]
        of_list = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        table = self.spark.read.schema(f"vec_id {self.kind}, unit array<double>, list int").parquet(self.path).where(F.col("list").isin(sorted(of_list)))
        names, width = np.array(ids, object), units.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[float, object]]] = {}
            kind = pa.null()
            for batch in batches:
                kind = batch.column("vec_id").type
                lists = batch.column("list").to_numpy()
                rows, unit = np.array(batch.column("vec_id").to_pylist(), object), _matrix(batch.column("unit"), width)
                for c in np.unique(lists):
                    here, who = np.flatnonzero(lists == c), of_list[int(c)]
                    for at in range(0, len(who), 512):
                        some = who[at : at + 512]
                        score = np.round(units[some] @ unit[here].T, DECIMALS)
                        for q, s in zip(some.tolist(), score, strict=True):
                            held = best.setdefault(q, [])
                            least = held[-1][0] if len(held) == k else -np.inf
                            good = np.flatnonzero(s >= least)
                            if len(good) > 4 * k:  # what is below the k-th (and the question itself) of these cannot stay
                                good = good[s[good] >= np.partition(s[good], -k - 1)[-k - 1]]
                            more = [(s[g], rows[here[g]]) for g in good if rows[here[g]] != names[q]]
                            if more:
                                best[q] = sorted({*held, *more}, key=lambda x: (-x[0], x[1]))[:k]
            out = [(names[q], v, float(s)) for q, held in best.items() for s, v in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out]).cast(t) for i, t in enumerate((kind, kind, pa.float64()))], names=["asked", "vec_id", "score"])

        return table.mapInArrow(run, ddl)


def chunks_of(found: DataFrame, pointers: DataFrame) -> DataFrame:
    """The nearest vectors with the chunks that point to them (chunk_id, vector_index, model_name)."""
    return found.join(pointers.select("chunk_id", F.col("vector_index").cast(found.schema["vec_id"].dataType).alias("vec_id"), "model_name"), "vec_id")
