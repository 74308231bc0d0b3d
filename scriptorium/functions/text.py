"""Lines, words and white space with the rules of Python strings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where lines end (Java regex).
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
#: The 29 code points that count as white space (Java regex).
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
MIN_WORD = 3


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def raw_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)


def lines(text: Column) -> Column:
    """The stripped lines that are not blank, in order."""
    return F.filter(F.transform(raw_lines(text), strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), lambda w: w != "")


def query_words(question: Column, shortest: int = MIN_WORD) -> Column:
    """The lower-case words of a question that are long enough to search for."""
    return F.filter(tokens(F.lower(question)), lambda w: F.length(w) >= shortest)


def char_preview(text: Column, limit: int = 2000) -> Column:
    """The first code points; empty where there is no text."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(limit))


def byte_preview(payload: Column, limit: int = 256) -> Column:
    """The first bytes as text; a character cut at the end becomes one replacement character."""
    return F.make_valid_utf8(F.substring(payload, 1, limit).cast("string"))


def token_count(preview: Column, empty_is_null: bool = True) -> Column:
    n = F.size(tokens(preview))
    return F.when(F.coalesce(preview, F.lit("")) == "", F.lit(None).cast("int") if empty_is_null else F.lit(0)).otherwise(n)


def utf8_or_latin1(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else one character a byte. A byte order mark stays."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def or_default(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def quote_plus(text: Column) -> Column:
    """Text as part of a URL, spaces as plus signs."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
