"""Stored payloads: texts as UTF-8 bytes, compressed behind a marker from a size on."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what a compressed payload begins with.
MARKER = b"gzip:"
LEVEL = 6


def _mapped(f: Callable[[object], object], kind: T.DataType) -> Callable[[Column], Column]:
    def each(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return F.pandas_udf(each, kind)


def _compressed(content: bytes) -> bytes:
    return MARKER + gzip.compress(bytes(content), LEVEL, mtime=0)


def _decoded(payload: bytes) -> str:
    """Marked bytes that are no gzip are taken as they are; what is not UTF-8 is no text."""
    raw = bytes(payload)
    if raw.startswith(MARKER):
        try:
            raw = gzip.decompress(raw[len(MARKER) :])
        except (OSError, EOFError):
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return ""


def payload(text: Column, threshold: int = 32768) -> Column:
    """The bytes to store. Only texts of the threshold or more go through Python; 0 turns compression off."""
    content = F.encode(text, "UTF-8")
    if not threshold:
        return content
    large = F.octet_length(content) >= threshold
    compressed = _mapped(_compressed, T.BinaryType())(F.when(large, content))
    return F.when(large, compressed).otherwise(content)


def text_of(stored: Column) -> Column:
    """The text of stored bytes; empty where there are none."""
    return F.coalesce(_mapped(_decoded, T.StringType())(stored), F.lit(""))
