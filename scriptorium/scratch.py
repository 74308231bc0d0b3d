"""Tables that steps share, and joins whose small side has been measured."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few narrow columns, ids of some forty signs among them, up to which a side of a join is broadcast; some 32 MB.
SMALL_ROWS = 200_000


def new_folder(spark: SparkSession, label: str = "lake") -> str:
    """A path of its own below spark.checkpoint.dir; below a temporary folder only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows of texts that go to a Python worker at once.
TEXTS = 1000


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written from texts that pass through Python, few of them do so at once, whatever the session says of other rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= TEXTS:
        yield
        return
    spark.conf.set(name, TEXTS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, written once: no lost executor costs what lies before it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_few(narrow: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast of a (materialized) table of a few narrow columns only when its rows have been counted."""
    return F.broadcast(narrow) if narrow.count() <= limit else narrow
