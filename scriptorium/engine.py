"""One object for the whole flow: ingest, ask, preview, chunks, status, reset, health."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import schema
from scriptorium.functions.text import char_preview, or_default
from scriptorium.operators import catalog, chunks, search
from scriptorium.operators.retention import TTL_SECONDS
from scriptorium.scratch import materialize, remove
from scriptorium.sources.store import TextStore
from scriptorium.sources.tables import Table
from scriptorium.sources.uploads import as_documents


class Engine:
    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL_SECONDS) -> None:
        self.spark = spark
        self.store = TextStore(spark, f"{path}/doc_text", ttl)
        self.documents = Table(spark, f"{path}/documents", schema.DOCUMENTS)
        self.chunks = Table(spark, f"{path}/chunks", schema.CHUNKS, "chunk_id")
        self.embeddings_map = Table(spark, f"{path}/embeddings_map", schema.EMBEDDINGS_MAP, "chunk_id")
        self.statuses = Table(spark, f"{path}/statuses", schema.STATUSES)
        self.staging = f"{path}/staging"

    def ingest(self, accepted: DataFrame) -> DataFrame:
        """Store accepted uploads under new ids: texts first, then their metadata, then chunk rows. Returns (doc_id, filename).

        The ids are fresh, so nothing can be there under them: all three are appended, and no table is read or written anew.
        """
        staged = f"{self.staging}/{uuid.uuid4().hex}"
        as_documents(accepted).write.parquet(staged)  # ids are random: they are made once
        docs = self.spark.read.parquet(staged)
        self.store.put(docs)
        now = F.current_timestamp()
        self.documents.append(docs.withColumns({"created_at": now, "updated_at": now}).select(*self.documents.read().columns))
        self.chunks.append(catalog.chunk_table_rows(chunks.chunk_rows(docs)))
        names = materialize(docs.select("doc_id", "filename"), "ingested")
        remove(self.spark, staged)
        return names

    def upsert(self, rows: DataFrame) -> None:
        """Documents under ids of the caller's own (doc_id, seq and other columns of the catalog), folded into their buckets alone."""
        now = F.current_timestamp()
        known = {"created_at": now, "updated_at": now, "status": F.lit("uploaded"), "storage": F.lit("store")}
        columns = {f.name: f for f in self.documents.read().schema.fields}
        full = rows.select("seq", *((F.col(c) if c in rows.columns else known.get(c, F.lit(None))).cast(f.dataType).alias(c) for c, f in columns.items()))
        self.documents.merge(materialize(full, "upserts"), catalog.upsert_documents)

    def add_chunks(self, rows: DataFrame) -> None:
        """Chunk rows under ids of the caller's own; those that are there already stay as they are."""
        rows = materialize(catalog.chunk_table_rows(rows).withColumn("seq", F.col("chunk_index").cast("long")), "chunk-rows")
        self.chunks.merge(rows, lambda held, new: held.unionByName(catalog.insert_absent(held, new).select(*held.columns)))

    def ask(self, questions: DataFrame, as_of: object = None) -> DataFrame:
        return search.ask(questions, self.store.texts(as_of, questions))

    def ask_as_of(self, questions: DataFrame, asked_at: str = "asked_at") -> DataFrame:
        """Questions answered from the text that each document had when it was asked."""
        return search.answered(self.store.texts_as_of(questions, asked_at).withColumnRenamed("text", "_text")).select(*questions.columns, "ok", "answer")

    def preview(self, ids: DataFrame, limit: int = 2000, as_of: object = None) -> DataFrame:
        return self.store.get(ids, as_of).select("doc_id", char_preview(F.col("text"), limit).alias("preview"))

    def chat(self, requests: DataFrame, as_of: object = None) -> DataFrame:
        """Previews for requests with path_id, query_id and session_id: the first that is given counts."""
        chosen = F.coalesce(F.nullif("path_id", F.lit("")), F.nullif("query_id", F.lit("")), F.col("session_id"))
        asked = requests.withColumn("doc_id", chosen)
        return asked.join(self.preview(asked.where("doc_id is not null"), as_of=as_of), "doc_id", "left").withColumn("preview", F.coalesce("preview", F.lit("")))

    def index(self, sessions: DataFrame, as_of: object = None) -> DataFrame:
        """The whole text for sessions with doc_id and extracted_text: the stored text, else the session's own."""
        joined = sessions.join(self.store.texts(as_of, sessions), "doc_id", "left")
        return joined.withColumn("text", or_default(F.coalesce(F.nullif("text", F.lit("")), F.col("extracted_text")), ""))

    def lookup(self, doc_id: str) -> DataFrame:
        one = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return catalog.lookup(catalog.with_statuses(self.documents.read(one), self.statuses.read(one)), doc_id)

    def catalog(self) -> DataFrame:
        """The documents with the last status set for each."""
        return catalog.with_statuses(self.documents.read(), self.statuses.read())

    def set_status(self, doc_id: str, status: str) -> None:
        """One row more; the documents themselves are not written again. An unknown id changes nothing."""
        self.statuses.append(self.spark.createDataFrame([(doc_id, status)], "doc_id string, status string").withColumn("updated_at", F.current_timestamp()))

    def map_embeddings(self, rows: DataFrame) -> None:
        known = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("model_name", "score")}
        self.embeddings_map.append(rows.select("chunk_id", F.col("vector_index").cast("int").alias("vector_index"), known["model_name"].cast("string").alias("model_name"), known["score"].cast("double").alias("score"), F.current_timestamp().alias("created_at")))

    def reset(self, ids: DataFrame) -> None:
        self.store.clear(ids)

    def health(self) -> DataFrame:
        store = self.store.healthy()
        return self.spark.createDataFrame([(store, store)], "ok boolean, store boolean")
