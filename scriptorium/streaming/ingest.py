"""Continuous ingestion of files, and the texts that are alive in a stream of puts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.engine import Engine
from scriptorium.functions.files import MAX_UPLOAD
from scriptorium.sources.uploads import accept


def ingest_files(spark: SparkSession, engine: Engine, source: str, checkpoint: str) -> StreamingQuery:
    """Ingest what is new under a folder since the checkpoint, then stop; start it again for what comes later."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(source)
    taken = files.where(F.col("length") <= MAX_UPLOAD).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")

    def store(batch: DataFrame, _: int) -> None:
        engine.ingest(accept(batch)[0])

    return taken.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_puts(puts: DataFrame, ttl: int) -> DataFrame:
    """The puts of a stream (doc_id, stored_at), a repeat within the time to live left out; state goes with the watermark."""
    return puts.withWatermark("stored_at", f"{ttl} seconds").dropDuplicatesWithinWatermark(["doc_id"])


def uploads_per_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events (ts, event_type) per window, late ones taken up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count().select("window.start", "window.end", "event_type", "count")
