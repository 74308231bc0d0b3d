"""Metadata tables: upsert, status, insert-if-absent, append, lookup, delete, as folds over snapshots."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import schema

#: What a repeated document updates; everything else keeps its first value.
MUTABLE = ("filename", "size_bytes", "total_pages")


def upsert_documents(existing: DataFrame, incoming: DataFrame, seq: str = "seq", key: str = "doc_id") -> DataFrame:
    """The table after the incoming rows, in the order of seq: first values stay, mutable ones (nulls too) are the last.

    created_at is the first, updated_at the last. One shuffle on the key, pre-aggregated on both sides.
    """
    names = [c for c in existing.columns if c != key]
    rows = existing.select(key, *names, F.lit(None).cast("long").alias("_seq")).unionByName(incoming.select(key, *names, F.col(seq).cast("long").alias("_seq")))
    order = F.struct(F.col("_seq").isNotNull(), "_seq")

    def folded(c: str) -> Column:
        pick = F.max_by if c in MUTABLE or c == "updated_at" else F.min_by
        return pick(F.struct(c), order)[c].alias(c)

    return rows.groupBy(key).agg(*map(folded, names)).select(existing.columns)


def update_status(documents: DataFrame, doc_id: object, status: str, now: datetime.datetime | None = None) -> DataFrame:
    """One document's status; an unknown id changes nothing."""
    hit = F.col("doc_id") == F.lit(doc_id)
    out = documents.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    if "updated_at" in documents.columns:
        out = out.withColumn("updated_at", F.when(hit, F.lit(now) if now else F.current_timestamp()).otherwise(F.col("updated_at")))
    return out


def with_statuses(documents: DataFrame, statuses: DataFrame) -> DataFrame:
    """Documents under the last of the statuses (doc_id, status, updated_at) that were set for them, if any."""
    last = statuses.groupBy("doc_id").agg(F.max_by(F.struct("status", "updated_at"), "updated_at").alias("_set"))
    given = documents.join(last, "doc_id", "left")
    columns = {"status": F.coalesce("_set.status", "status"), "updated_at": F.coalesce("_set.updated_at", "updated_at")}
    return given.select(*(columns.get(c, F.col(c)).alias(c) for c in documents.columns))


def lookup(documents: DataFrame, doc_id: object) -> DataFrame:
    return documents.where(F.col("doc_id") == F.lit(doc_id)).limit(1)


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id", seq: str = "seq") -> DataFrame:
    """The incoming rows whose key is new, the first of each key by seq: what to append."""
    names = [c for c in incoming.columns if c not in (key, seq)]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*names), seq).alias("row")).select(key, "row.*")
    return first.join(existing.select(key), key, "left_anti")


def chunk_table_rows(chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """Chunk metadata as rows of the chunks table: an id where there is none, one creation time in whole seconds."""
    at = F.date_trunc("second", now if now is not None else F.current_timestamp())
    given = F.col("chunk_id") if "chunk_id" in chunks.columns else F.lit(None).cast("string")
    named = {"chunk_id": F.coalesce(given, F.uuid()), "created_at": at}
    columns = [part.strip().split(" ") for part in schema.CHUNKS.split(",")]
    return chunks.select(*(named.get(n, F.col(n) if n in chunks.columns else F.lit(None)).cast(kind).alias(n) for n, kind in columns))


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.unionByName(incoming, allowMissingColumns=True)


def clear(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not among those gone; absent keys are no error."""
    return table.join(gone.select(key).distinct(), key, "left_anti")
