"""Byte-based chunk plans, their metadata, and putting chunks together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import byte_preview, token_count

CHUNK_BYTES = 4 * 1024 * 1024
MAX_SINGLE = 100 * 1024 * 1024
COMPRESS_FROM = 32768
PREVIEW_BYTES = 256


def is_compressed(text: Column, threshold: int = COMPRESS_FROM) -> Column:
    """Whether a text is large enough to be stored compressed; a threshold of 0 turns that off."""
    return (F.octet_length(text) >= threshold) if threshold else F.lit(False)


def chunk_count(size: Column, chunk_bytes: int = CHUNK_BYTES) -> Column:
    return F.ceil(size / F.lit(float(chunk_bytes))).cast("long")


def storage_key(doc_id: Column, index: Column | None = None) -> Column:
    key = F.concat(F.lit("doc:"), doc_id.cast("string"))
    return key if index is None else F.concat(key, F.lit(":chunk:"), index.cast("string"))


def meta_key(doc_id: Column) -> Column:
    return F.concat(storage_key(doc_id), F.lit(":meta"))


def chunk_meta(text: Column, chunk_bytes: int = CHUNK_BYTES, threshold: int = COMPRESS_FROM) -> Column:
    """chunks, orig_bytes, stored_bytes, compressed. Sizes are those of the text: the file format compresses."""
    size = F.octet_length(text).cast("long")
    return F.struct(chunk_count(size, chunk_bytes).cast("int").alias("chunks"), size.alias("orig_bytes"), size.alias("stored_bytes"), is_compressed(text, threshold).alias("compressed"))


def split_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, payload): contiguous slices of the UTF-8 bytes."""
    rows = docs.where(F.octet_length("text") > 0).select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    count = chunk_count(F.octet_length("bytes"), chunk_bytes)
    rows = rows.select("doc_id", "bytes", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("chunk_index"))
    start = F.col("chunk_index").cast("long") * chunk_bytes
    payload = F.substring("bytes", (start + 1).cast("int"), F.lit(chunk_bytes))
    return rows.select("doc_id", "chunk_index", start.alias("start_offset"), (start + F.octet_length(payload)).alias("end_offset"), payload.alias("payload"))


def chunk_spans(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset) of the same slices, from the sizes of the texts alone."""
    size = F.octet_length("text")
    rows = docs.where(size > 0).select("doc_id", size.cast("long").alias("size"))
    rows = rows.select("doc_id", "size", F.explode(F.sequence(F.lit(0), chunk_count(F.col("size"), chunk_bytes).cast("int") - 1)).alias("chunk_index"))
    start = F.col("chunk_index").cast("long") * chunk_bytes
    return rows.select("doc_id", "chunk_index", start.alias("start_offset"), F.least(start + chunk_bytes, F.col("size")).alias("end_offset"))


def chunk_rows(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, single: int = MAX_SINGLE, preview: int = PREVIEW_BYTES) -> DataFrame:
    """Metadata of the stored chunks: one row for a text that is stored whole, else one for each chunk."""
    size = F.octet_length("text")
    whole = docs.where(size.between(1, single)).select(
        "doc_id", F.lit(0).alias("chunk_index"), storage_key(F.col("doc_id")).alias("storage_key"), size.cast("long").alias("stored_bytes"), byte_preview(F.encode("text", "UTF-8"), preview).alias("text_preview")
    )
    parts = split_chunks(docs.where(size > single), chunk_bytes).select(
        "doc_id", "chunk_index", storage_key(F.col("doc_id"), F.col("chunk_index")).alias("storage_key"), F.octet_length("payload").cast("long").alias("stored_bytes"), byte_preview(F.col("payload"), preview).alias("text_preview")
    )
    return whole.unionByName(parts).withColumn("token_count", token_count(F.col("text_preview")))


def join_chunks(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, text): the chunks of a document in order; empty where any of the expected number is missing."""
    got = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("chunk_index", F.hex("payload").alias("hex")))).alias("parts"))
    joined = expected.select("doc_id", "chunks").join(got, "doc_id", "left")
    text = F.unhex(F.array_join(F.transform("parts", lambda p: p.hex), "")).cast("string")
    return joined.select("doc_id", F.when(F.col("n") == F.col("chunks"), F.make_valid_utf8(text)).otherwise("").alias("text"))
