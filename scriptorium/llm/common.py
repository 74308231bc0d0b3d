"""Helpers that several corpus operators share: scratch tables, size-checked broadcasts, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.scratch import text_batches  # noqa: F401

#: Estimated bytes up to which a side of a join is sent to every executor; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows for each core up to which a round of an iteration is written as one file for each core.
FEW_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"scriptorium-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the scratch folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a Parquet table in the shared scratch folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what lies before) and keeps one computation
    where several later steps read the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Latest:
    """The table of an iteration's last round, in the shared scratch folder; the round before it is deleted once the next is written."""

    def __init__(self, label: str) -> None:
        self.label, self.path = label, None

    def put(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write the next round's table; where it is known to have so many rows at most, a few of them as few files."""
        spark, before = df.sparkSession, self.path
        self.path = new_path(spark, self.label)
        if rows is not None and rows < FEW_ROWS * spark.sparkContext.defaultParallelism:
            df = df.coalesce(spark.sparkContext.defaultParallelism)
        df.write.parquet(self.path)
        if before:
            remove(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any longer."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def row_bytes(df: DataFrame) -> Column:
    """An estimate of a row's bytes in memory; arrays and maps count by their elements."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * flat(kind.elementType) + 24
        if isinstance(kind, T.MapType):
            return F.coalesce(F.size(c), F.lit(0)) * (flat(kind.keyType) + flat(kind.valueType)) + 48
        return F.lit(flat(kind))

    def flat(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return 16 + sum(flat(f.dataType) for f in kind.fields)
        return 48 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8

    return reduce(lambda x, f: x + of(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(16)).cast("long")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the bytes of the (materialized) table have been summed up and are within the limit."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit else df


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows numbered from 1 within their group, by order; rows that tie come as they lie in the input.

    The rows are sorted over range partitions, so that a group of any size, also of rows that are all the same, is
    spread over as many tasks as it fills; a row's number is its place in its partition plus the rows that the group
    has in earlier partitions.
    """
    keys = [*group, *order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    share = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    share = share.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    share = share.withColumnsRenamed({c: f"_of_{c}" for c in [*group, "_part"]})
    same = F.lit(True)
    for c in [*group, "_part"]:
        same = same & placed[c].eqNullSafe(share[f"_of_{c}"])
    return placed.join(share, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_skip") + 1).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, pattern: str = "[^\\x20\\x09-\\x0D]+") -> Column:
    """The words of a text in order; no words for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
