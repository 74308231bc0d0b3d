"""Joins of intervals that overlap, and the places of lines and chunks in the bytes and words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import LINE_BREAK, raw_lines, strip, tokens
from scriptorium.operators import search
from scriptorium.operators.search import TOP

#: Words of a chunk, those that it shares with the next one, and signs that end a sentence.
CHUNK_TOKENS, OVERLAP = 256, 32
SENTENCE_END = r"[.!?…][\"'”’»)\]]*$"


def interval_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, right_start: str, right_end: str, width: int) -> DataFrame:
    """The pairs of rows of one key whose half-open intervals overlap.

    Both are dealt to bins of a width of about that of the intervals, so that a row meets only what lies near it, however
    many rows its key has; a pair that shares several bins counts in the one in which the later of the two begins. Empty intervals overlap nothing.
    """

    def binned(df: DataFrame, a: str, b: str) -> DataFrame:
        bins = F.sequence(F.call_function("div", F.col(a), F.lit(width)), F.call_function("div", F.col(b) - 1, F.lit(width)))
        return df.where(F.col(a) < F.col(b)).withColumn("_bin", F.explode(bins))

    one = binned(left, start, end)
    two = binned(right.withColumnRenamed(key, "_right_key"), right_start, right_end).withColumnRenamed("_bin", "_right_bin")
    overlap = (F.col(start) < F.col(right_end)) & (F.col(right_start) < F.col(end))
    first = F.call_function("div", F.greatest(F.col(start), F.col(right_start)), F.lit(width)) == F.col("_bin")
    met = one.join(two, (F.col(key) == F.col("_right_key")) & (F.col("_bin") == F.col("_right_bin")) & overlap & first)
    return met.drop("_bin", "_right_bin", "_right_key")


def located_hits(docs: DataFrame, question: str, top: int = TOP) -> DataFrame:
    """(doc_id, hit_no, line, line_start, line_end): the first hits with the bytes at which their lines begin and end, without the line's own end."""
    words = search.words_of(question)
    found = docs.where(search.may_match(F.col("text"), question)) if words else docs.where("text is not null")
    ends = F.regexp_extract_all(F.col("text"), F.lit(LINE_BREAK), F.lit(0))
    each = F.transform(raw_lines(F.col("text")), lambda s, k: F.struct(s.alias("raw"), k.alias("k")))
    blank = F.lit(f"(?!{search.SPACE})(?s:.)")
    met = F.slice(F.filter(each, lambda x: search._all_words(x.raw, words) & F.regexp_like(x.raw, blank)), 1, top)
    rows = found.select("doc_id", raw_lines(F.col("text")).alias("_lines"), ends.alias("_ends"), F.posexplode(met).alias("n", "hit"))
    k = F.col("hit.k")
    before = F.octet_length(F.array_join(F.slice("_lines", F.lit(1), k), "")) + F.octet_length(F.array_join(F.slice("_ends", F.lit(1), k), ""))
    start = F.when(k == 0, 0).otherwise(before).cast("long")
    return rows.select("doc_id", (F.col("n") + 1).alias("hit_no"), strip(F.col("hit.raw")).alias("line"), start.alias("line_start"), (start + F.octet_length("hit.raw")).alias("line_end"))


def chunks_of_hits(hits: DataFrame, chunks: DataFrame, chunk_bytes: int) -> DataFrame:
    """Hits with the chunks (doc_id, chunk_index, start_offset, end_offset) in whose bytes their lines lie, a row for each: lines may cross borders."""
    return interval_join(hits, chunks, "doc_id", "line_start", "line_end", "start_offset", "end_offset", chunk_bytes)


def sentence_chunks(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, token_count, text): overlapping chunks of whole words, by sentences where these are near.

    Offsets are numbers of words of the text, so start_offset and end_offset of the chunks table are filled. Each chunk answers for
    ``size - overlap`` words of its own. It begins with the sentence that its first word stands in, if that begins at most ``overlap`` words
    earlier, and ends with the sentence that its shared words end in, if that ends at most so many words later. Texts without words have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("chunks share fewer words than they have")
    step = size - overlap
    words = docs.where("text is not null").select("doc_id", tokens(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    each = words.select("doc_id", "_words", F.posexplode(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step))).alias("chunk_index", "_own"))
    own, n = F.col("_own"), F.size("_words")

    def ends(look: Column) -> Column:
        return F.transform(look, lambda w: w.rlike(SENTENCE_END))

    back = F.least(own, F.lit(overlap))
    behind = F.when(back > 0, F.reverse(ends(F.slice("_words", own - back + 1, back)))).otherwise(F.array().cast("array<boolean>"))
    to_sentence = F.array_position(behind, F.lit(True)) - 1  # words since the last end of a sentence
    # the beginning of the text begins a sentence as well
    start = F.when(to_sentence >= 0, own - to_sentence).when(own <= overlap, 0).otherwise(own).cast("int")
    least = F.least(n, own + step + overlap)
    ahead = F.when(least < n, ends(F.slice("_words", least, F.least(F.lit(overlap + 1), n - least + 1)))).otherwise(F.array().cast("array<boolean>"))
    more = F.array_position(ahead, F.lit(True))
    end = F.when(more > 0, least + more - 1).otherwise(least).cast("int")
    cut = each.withColumns({"_start": start, "_end": end})
    return cut.select("doc_id", "chunk_index", F.col("_start").cast("long").alias("start_offset"), F.col("_end").cast("long").alias("end_offset"), (F.col("_end") - F.col("_start")).alias("token_count"), F.array_join(F.slice("_words", F.col("_start") + 1, F.col("_end") - F.col("_start")), " ").alias("text"))
