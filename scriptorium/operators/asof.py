"""As-of joins: for each row the last row of another table that its time has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.scratch import broadcast_if_few, materialize


def _same(a: DataFrame, b: DataFrame, names: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"{prefix}{n}"])
    return out


def as_of(asked: DataFrame, versions: DataFrame, key: str, asked_at: str, valid_from: str, order: list[str] | None = None) -> DataFrame:
    """asked with a column `version`, the last of the versions of the same key that is not later (a struct of its columns, or null).

    Rows of both are sorted by key and time over range partitions, so that a key of any size is spread over as many tasks as
    it fills; the last version of a partition is carried over to those behind it, a row for each key and partition. Of versions at one
    time the last by `order` counts; a version of the very time of a question is seen. A null key or time sees, and is, nothing.
    Carry narrow columns: texts are better fetched afterwards by what the version names.
    """
    order = order or []
    held = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull())
    value = F.struct(*(F.col(c) for c in versions.columns))
    none_asked, none_value = F.lit(None).cast(asked.select(F.struct("*").alias("x")).schema["x"].dataType), F.lit(None).cast(versions.select(value.alias("x")).schema["x"].dataType)
    right = held.select(F.col(key).alias("_key"), F.col(valid_from).alias("_time"), F.lit(0).alias("_kind"), F.struct(*order).alias("_order") if order else F.lit(0).alias("_order"), none_asked.alias("_asked"), value.alias("_value"))
    left = asked.select(F.col(key).alias("_key"), F.col(asked_at).alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast(right.schema["_order"].dataType).alias("_order"), F.struct("*").alias("_asked"), none_value.alias("_value"))
    keys = ["_key", "_time", "_kind", "_order", "_tie"]
    placed = left.unionByName(right).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "as-of")

    last = placed.groupBy("_key", "_part").agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the key
    carried = last.select("_key", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")
    carried = materialize(carried.withColumnsRenamed({"_key": "_of_key", "_part": "_of_part"}).select("_of_key", "_of_part", "_carried"), "as-of-carried")
    here = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)  # never more than a partition
    seen = placed.withColumn("_value", F.last("_value", ignorenulls=True).over(here)).where("_kind = 1").drop("_order")
    few = broadcast_if_few(carried)
    out = seen.join(few, F.col("_key").eqNullSafe(F.col("_of_key")) & (F.col("_part") == F.col("_of_part")), "left")
    return out.select("_asked.*", F.when(F.col("_key").isNotNull() & F.col("_time").isNotNull(), F.coalesce("_value", "_carried")).alias("version"))
