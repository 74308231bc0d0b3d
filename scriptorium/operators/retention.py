"""Retention: a text lives up to and including its age limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 86400


def alive(stored_at: Column, as_of: Column, ttl: int = TTL_SECONDS) -> Column:
    return stored_at >= as_of - F.make_dt_interval(secs=F.lit(float(ttl)).cast("decimal(18,6)"))


def latest(store: DataFrame, key: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """The last version of each key, by stored_at or by the columns of order. All its columns are shuffled: leave texts out."""
    names = [c for c in store.columns if c != key]
    return store.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*(order or ["stored_at"]))).alias("row")).select(key, "row.*")
