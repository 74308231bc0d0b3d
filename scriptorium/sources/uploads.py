"""Uploads as DataFrames: JSON bodies, forms and files, with what is rejected and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.files import MAX_UPLOAD, extension, is_allowed, secure_filename
from scriptorium.functions.text import or_default
from scriptorium.sources.extract import extract

#: Why an upload is rejected.
NO_INPUT = "no text provided and no file uploaded"
NO_NAME = "empty filename or no file"
UNSUPPORTED = "unsupported file type: "
TOO_LARGE = "file too large"
FIELDS = "user_id string, filename string, text string"


def payloads(rows: DataFrame, default_name: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows with user_id, filename and text: those with text, under a default name."""
    has = F.coalesce("text", F.lit("")) != ""
    named = rows.withColumn("filename", or_default(F.col("filename"), default_name))
    return named.where(has), rows.where(~has).select("filename", F.lit(NO_INPUT).alias("error"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return payloads(spark.read.schema(FIELDS).json(path), "payload.txt")


def parse_json(bodies: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """The same for rows with a JSON body each; other columns stay. What is no JSON object has no text."""
    others = [c for c in bodies.columns if c not in (column, "user_id", "filename", "text")]
    return payloads(bodies.select(*others, F.from_json(column, FIELDS).alias("_body")).select(*others, "_body.*"), "payload.txt")


def read_forms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return payloads(rows, "form.txt")


def within_limit(files: DataFrame, limit: int = MAX_UPLOAD) -> tuple[DataFrame, DataFrame]:
    """(those within the limit, rejected) of rows with filename and content."""
    large = F.octet_length("content") > limit
    return files.where(~F.coalesce(large, F.lit(False))), files.where(large).select("filename", F.lit(TOO_LARGE).alias("error"))


def read_files(spark: SparkSession, path: str, limit: int = MAX_UPLOAD) -> tuple[DataFrame, DataFrame]:
    """Files under a path; larger ones are not read at all, as the limit is pushed into the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    large = files.where(F.col("length") > limit).select(name.alias("filename"), F.lit(TOO_LARGE).alias("error"))
    accepted, rejected = accept(files.where(F.col("length") <= limit).select(name.alias("filename"), "content"))
    return accepted, rejected.unionByName(large)


def accept(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with text, rejected) of rows with filename and content."""
    blank = F.coalesce("filename", F.lit("")) == ""
    safe = files.withColumn("filename", F.when(blank, "").otherwise(secure_filename(F.col("filename"))))
    error = F.when(F.col("filename") == "", F.lit(NO_NAME)).when(~is_allowed(F.col("filename")), F.concat(F.lit(UNSUPPORTED), extension(F.col("filename"))))
    judged = safe.withColumn("error", error)
    return extract(judged.where("error is null").drop("error")), judged.where("error is not null").select("filename", "error")


def as_documents(accepted: DataFrame) -> DataFrame:
    """Accepted uploads as rows to store: a new id, and the size in bytes of the file if it is a PDF, else of the text."""
    pdf = extension(F.col("filename")) == "pdf"
    size = F.octet_length("text").cast("long")
    if "content" in accepted.columns:
        size = F.when(pdf, F.octet_length("content").cast("long")).otherwise(size)
    optional = {c: F.col(c) if c in accepted.columns else F.lit(None) for c in ("user_id", "total_pages", "extract_error")}
    return accepted.select(
        F.uuid().alias("doc_id"), optional["user_id"].cast("string").alias("user_id"), "filename", F.lit("store").alias("storage"), size.alias("size_bytes"), F.lit("uploaded").alias("status"),
        optional["total_pages"].cast("int").alias("total_pages"), optional["extract_error"].cast("string").alias("extract_error"), F.coalesce("text", F.lit("")).alias("text"),
    )
