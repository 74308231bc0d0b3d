"""The text store, and tables of a database."""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import schema
from scriptorium.operators.asof import as_of as as_of_join
from scriptorium.operators.retention import TTL_SECONDS, alive, latest
from scriptorium.scratch import broadcast_if_few, materialize
from scriptorium.sources.tables import Table


class TextStore:
    """Texts by id with a time to live; the last text stored under an id counts. Parquet compresses what is stored.

    A text is found by its row's own id: which row counts is decided on narrow columns, and texts are fetched last.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL_SECONDS) -> None:
        self.table, self.ttl = Table(spark, path, schema.DOC_TEXT), ttl

    def _rows(self, texts: DataFrame, text: Column, at: Column, cleared: bool) -> DataFrame:
        return texts.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), at.alias("stored_at"), F.lit(time.time_ns()).cast("long").alias("written"), F.uuid().alias("row_id"), F.lit(cleared).alias("cleared"))

    def put(self, texts: DataFrame) -> None:
        """Rows with doc_id and text; those without an id are not stored."""
        at = F.col("stored_at") if "stored_at" in texts.columns else F.current_timestamp()
        self.table.append(self._rows(texts.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != ""), F.coalesce("text", F.lit("")), at, False))

    def clear(self, ids: DataFrame, at: object = None) -> None:
        """Mark the ids as cleared: a row without text, which is the last stored one. compact() drops what no longer counts."""
        when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        self.table.append(self._rows(ids.where("doc_id is not null").select("doc_id").distinct(), F.lit(None).cast("string"), when, True))

    def versions(self, ids: DataFrame | None = None) -> DataFrame:
        """(doc_id, stored_at, written, row_id, cleared) of all that was stored; only the folders of the ids are read, and no text."""
        rows = self.table.read(ids).select("doc_id", "stored_at", "written", "row_id", "cleared")
        return rows if ids is None else rows.join(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def texts(self, as_of: object = None, ids: DataFrame | None = None) -> DataFrame:
        """(doc_id, text) of the texts that are alive at a time, all or those of the ids."""
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        newest = latest(self.versions(ids).where(F.col("stored_at") <= now), "doc_id", ["stored_at", "written", "row_id"])
        live = newest.where(alive(F.col("stored_at"), now, self.ttl) & ~F.col("cleared"))
        return self._fetched(live.select("doc_id", "row_id"), ids)

    def _fetched(self, live: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        few = broadcast_if_few(materialize(live, "live-texts"))
        return self.table.read(ids).select("doc_id", "row_id", "text").join(few, ["doc_id", "row_id"], "left_semi").select("doc_id", "text")

    def texts_as_of(self, asked: DataFrame, asked_at: str = "asked_at") -> DataFrame:
        """asked (doc_id, asked_at, other columns) with the text that was alive at each row's own time, or empty."""
        named = asked.withColumn("doc_id", F.col("doc_id").cast("string"))
        seen = as_of_join(named, self.versions(named), "doc_id", asked_at, "stored_at", ["written", "row_id"])
        live = alive(F.col("version.stored_at"), F.col(asked_at), self.ttl) & ~F.col("version.cleared")
        seen = materialize(seen.select(*asked.columns, F.when(live, F.col("version.row_id")).alias("_row")), "seen-texts")
        rows = materialize(seen.where("_row is not null").select("_row").distinct(), "seen-rows")
        texts = self.table.read(named).select(F.col("row_id").alias("_row"), "text").join(broadcast_if_few(rows), "_row", "left_semi")
        return seen.join(texts, "_row", "left").select(*asked.columns, F.coalesce("text", F.lit("")).alias("text"))

    def get(self, ids: DataFrame, as_of: object = None) -> DataFrame:
        """(doc_id, text) of the ids; empty where nothing is stored, or no longer."""
        wanted = ids.select("doc_id").distinct()
        return wanted.join(self.texts(as_of, wanted), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def compact(self) -> None:
        """Keep the last text of each id and nothing of cleared ones, in the buckets that have several folders."""

        def fold(rows: DataFrame) -> DataFrame:
            newest = latest(rows.drop("text"), "doc_id", ["stored_at", "written", "row_id"]).where(~F.col("cleared"))
            return rows.join(broadcast_if_few(materialize(newest.select("row_id"), "kept-texts")), "row_id", "left_semi").select(*rows.columns)

        self.table.compact(fold)

    def healthy(self) -> bool:
        try:
            self.table.read().limit(1).count()
        except Exception:
            return False
        return True


def database_url(host: str, user: str, password: str, name: str, port: str = "5432") -> str:
    """A JDBC URL; empty where a part is missing."""
    parts = (host, user, password, name)
    return f"jdbc:postgresql://{host}:{port}/{name}?user={quote_plus(user)}&password={quote_plus(password)}" if all(parts) else ""


def read_database(spark: SparkSession, url: str, table: str) -> DataFrame:
    if not url:
        raise RuntimeError("no database is configured")
    return spark.read.format("jdbc").options(url=url, dbtable=table).load()


def write_database(rows: DataFrame, url: str, table: str, batch: int = 100) -> None:
    """Append rows to a table of a database, so many a statement."""
    if not url:
        raise RuntimeError("no database is configured")
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch).mode("append").save()


def conflict_sql(table: str, staging: str, columns: list[str], key: str, mutable: list[str] | None = None) -> str:
    """Insert the rows of a staging table; what is there already keeps all but its mutable columns, or stays as it is where none are named."""
    names = ", ".join(columns)
    rule = f"UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in mutable)}" if mutable else "NOTHING"
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} ON CONFLICT ({key}) DO {rule}"


def upsert_database(rows: DataFrame, url: str, table: str, key: str, mutable: list[str] | None = None, batch: int = 100) -> None:
    """Bring rows (one for each key) into a table of a database by its own conflict rule: tasks fill a staging table, and one statement takes it over."""
    staging = f"{table}_{uuid.uuid4().hex[:12]}"
    write_database(rows, url, staging, batch)
    connection = rows.sparkSession.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(conflict_sql(table, staging, rows.columns, key, mutable))
        statement.executeUpdate(f"DROP TABLE {staging}")
    finally:
        connection.close()


def tables(spark: SparkSession) -> DataFrame:
    """(name, is_temporary) of the tables and views of the session."""
    rows = [(t.name, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, is_temporary boolean")
