"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become arrays of word hashes. Over every ``window`` consecutive words the smallest of the ``gram``-word hashes
inside is a fingerprint, so a span of ``window`` words that a document shares with an item has the same fingerprint in
both. Fingerprints of documents and items are joined; only rows with a common fingerprint are extended: their whole
windows are joined with the distinct windows of all items, and the words they cover are counted; only then the distinct windows of a
document are given the items that have them. Windows are compared by 64-bit hashes of the 64-bit hashes of their words, not letter
by letter, so two different ones are taken for the same with a probability of some 2 ** -63.
Items shorter than a window are one window of their own length and are joined by the hash of all of it.

Defined results: null or empty text has no words; items without words match nothing; very long texts and items are compared whole; repeated rows are judged alike
and kept apart; an empty documents or benchmark table is no error; other columns of the inputs are left out by
``contamination`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import ascii_lower, broadcast_if_small, materialize, words

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
GRAM = 5


def hashes(text: Column) -> Column:
    """A 64-bit hash for each word of the text."""
    return F.transform(words(ascii_lower(text), WORD), lambda w: F.xxhash64(w))


def spans(h: Column, n: Column | int) -> Column:
    """The hash of every n consecutive words, in order."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(h) >= n, F.sequence(F.lit(1), F.size(h) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, n)))


def fingerprints(grams: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The distinct smallest gram hashes of all windows."""
    wide = window - gram + 1
    starts = F.when(F.size(grams) >= wide, F.sequence(F.lit(0), F.size(grams) - wide)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.least(*(grams[i + k] for k in range(wide)))))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, wide, span): the distinct windows of each item; wide is less than the window for short items."""
    h = benchmark.select("item_id", hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    wide = F.least(F.size("h"), F.lit(window))
    return h.select("item_id", wide.alias("wide"), F.explode(spans(F.col("h"), wide)).alias("span")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per distinct (doc_id, text_hash): n_words, n_rows and whether a fingerprint or a short item met (met).

    And the extended hits (doc_id, text_hash, at, wide, span), and the windows of the items (item_id, wide, span).
    """
    items = materialize(item_windows(benchmark, window), "bench-windows")
    grams = benchmark.select(hashes(F.col("text")).alias("h")).select(spans(F.col("h"), gram).alias("g"))
    marks = grams.select(F.explode(fingerprints(F.col("g"), window, gram)).alias("mark"))
    short = [r[0] for r in items.where(F.col("wide") < window).select("wide").distinct().collect()]  # fewer than `window` values
    marks = materialize(marks.unionByName(items.where(F.col("wide") < window).select(F.col("span").alias("mark"))).distinct(), "bench-marks")

    # a select for each array: as one nested expression, lambdas would compute the inner arrays anew for every element
    h = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashes(F.col("text")).alias("h"))
    grams = h.select("*", spans(F.col("h"), gram).alias("g"))
    found = grams.select("*", F.concat(fingerprints(F.col("g"), window, gram), *(spans(F.col("h"), n) for n in short)).alias("marks"))
    each = found.select("doc_id", "text_hash", F.size("h").cast("long").alias("n_words"), F.posexplode_outer("marks").alias("k", "mark"))
    met = each.join(broadcast_if_small(marks.withColumn("met", F.lit(1))), "mark", "left")
    book = met.groupBy("doc_id", "text_hash", "n_words").agg(F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, 1).otherwise(0)).alias("n_rows"), F.coalesce(F.max("met"), F.lit(0)).alias("met"))
    book = materialize(book, "bench-book")

    some = broadcast_if_small(materialize(book.where("met = 1").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "bench-met"))
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    source = source.join(some, source.doc_id.eqNullSafe(some.d) & (source.text_hash == some.t), "left_semi")
    whole = source.select("doc_id", "text_hash", hashes(F.col("text")).alias("h"))
    at = [whole.select("doc_id", "text_hash", F.lit(n).alias("wide"), F.posexplode(spans(F.col("h"), n)).alias("at", "span")) for n in [window, *short]]
    every = at[0]
    for more in at[1:]:
        every = every.unionByName(more)
    whole = materialize(items.select("wide", "span").distinct(), "bench-spans")
    hits = every.join(broadcast_if_small(whole), ["wide", "span"]).select("doc_id", "text_hash", "at", "wide", "span").distinct()
    return book, hits, items


def summary(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    book, hits, items = contamination(docs, benchmark, window, gram)
    hits = materialize(hits, "bench-hits")
    key = ["doc_id", "text_hash"]
    covered = hits.select(*key, F.explode(F.sequence("at", F.expr("at + wide - 1"))).alias("word")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    of_items = hits.select(*key, "wide", "span").distinct().join(broadcast_if_small(items), ["wide", "span"])
    named = of_items.select(*key, "item_id").distinct().groupBy(*key).agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found = covered.alias("c").join(named.alias("n"), F.expr("c.doc_id <=> n.doc_id and c.text_hash = n.text_hash"))
    found = found.select(F.col("c.doc_id").alias("d"), F.col("c.text_hash").alias("t"), "n_hit", "item_ids")
    book = book.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    joined = book.join(found, book.doc_id.eqNullSafe(found.d) & (book.text_hash == found.t), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows, with all their columns, that share no window with the benchmark."""
    _, hits, _ = contamination(docs, benchmark, window, gram)
    bad = materialize(hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "bench-bad")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (plain[names[docs.columns.index(c)]] for c in ("doc_id", "text"))
    return plain.join(broadcast_if_small(bad), doc_id.eqNullSafe(bad["_id"]) & (F.xxhash64(text) == bad["_hash"]), "left_anti").toDF(*docs.columns)
