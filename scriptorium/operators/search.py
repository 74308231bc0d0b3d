"""Keyword search over the lines of documents.

A line is a hit when it contains every searched word, wherever it stands in the line; a question without a word that
is long enough is met by every line. The first hits of a document, in its order, are the answer.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import MIN_WORD, SPACE, lines, query_words, raw_lines, strip

TOP = 8
#: What is answered.
NO_HIT = "I couldn't find a direct keyword match. Once wired to your Python LLM pipeline, I'll answer semantically. Try different keywords for now."
HEADING = "Here are some lines that look relevant:\n\n"
NO_QUESTION = "Please ask a question."
NO_TEXT = "No document text available yet. Please upload a file first."


def _all_words(line: Column, found: list[str]) -> Column:
    low = F.lower(line)
    return reduce(lambda c, w: c & F.contains(low, F.lit(w)), found, F.lit(True))


def words_of(question: str, shortest: int = MIN_WORD) -> list[str]:
    """The searched words of a question that is known when the plan is made; the rule of query_words."""
    return [w for w in re.split(f"{SPACE}+", question.lower()) if len(w) >= shortest]


def hits(text: Column, question: str, top: int = TOP) -> Column:
    """The first hits as an array, without a shuffle; what survives the match is stripped, not every line."""
    found = words_of(question)
    if not found:
        return F.slice(lines(text), 1, top)
    matched = F.filter(raw_lines(text), lambda s: _all_words(s, found))
    return F.transform(F.slice(matched, 1, top), strip)


def may_match(text: Column, question: str) -> Column:
    """True wherever a line can match: every word is somewhere in the text."""
    return _all_words(text, words_of(question))


def search_lines(docs: DataFrame, question: str, top: int = TOP) -> DataFrame:
    """(doc_id, hit_no, line): a row per hit. Texts that lack a word are left before they are split."""
    found = docs.where(may_match(F.col("text"), question)) if words_of(question) else docs
    at = F.posexplode(hits(F.col("text"), question, top)).alias("k", "line")
    return found.select("doc_id", at).select("doc_id", (F.col("k") + 1).alias("hit_no"), "line")


def search_lines_ranked(docs: DataFrame, question: str, top: int = TOP) -> DataFrame:
    """The same by ranking rows per line, for comparison with SQL engines."""
    each = docs.select("doc_id", F.posexplode(raw_lines(F.col("text"))).alias("line_no", "raw"))
    met = each.where(_all_words(F.col("raw"), words_of(question)) & F.col("raw").rlike(f"(?!{SPACE})(?s:.)"))
    first = Window.partitionBy("doc_id").orderBy("line_no")
    return met.withColumn("hit_no", F.row_number().over(first)).where(F.col("hit_no") <= top).select("doc_id", "hit_no", strip(F.col("raw")).alias("line"))


def answer_of(found: Column) -> Column:
    bullets = F.array_join(F.transform(found, lambda h: F.concat(F.lit("• "), h)), "\n")
    return F.when(F.size(found) == 0, F.lit(NO_HIT)).otherwise(F.concat(F.lit(HEADING), bullets))


def search_answers(docs: DataFrame, question: str, top: int = TOP) -> DataFrame:
    return docs.select("doc_id", answer_of(hits(F.col("text"), question, top)).alias("answer"))


def answered(asked: DataFrame, top: int = TOP) -> DataFrame:
    """Rows with question and _text (empty where there is none), with ok and answer."""
    rows = asked.withColumn("_asked", strip(F.coalesce("question", F.lit("")))).withColumn("_words", query_words(F.col("_asked")))
    matched = F.filter(raw_lines(F.col("_text")), lambda s: _holds(s, F.col("_words")))
    found = F.transform(F.slice(matched, 1, top), strip)
    return _judged(rows, found, F.col("_text") != "")


def _holds(line: Column, wanted: Column) -> Column:
    return F.forall(wanted, lambda w: F.contains(F.lower(line), w)) & line.rlike(f"(?!{SPACE})(?s:.)")


def _judged(rows: DataFrame, found: Column, has_text: Column) -> DataFrame:
    answer = F.when(F.col("_asked") == "", F.lit(NO_QUESTION)).when(~has_text, F.lit(NO_TEXT)).otherwise(answer_of(found))
    return rows.withColumns({"ok": (F.col("_asked") != "") & has_text, "answer": answer})


#: Questions that share a copy of a text.
TOGETHER = 64


def ask(questions: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """Questions (with doc_id and question, and any other columns) answered from the texts of their documents: ok, answer.

    Distinct sets of words travel to a text, in groups of about ``TOGETHER``, so that a text is copied once for so many questions and
    split into lines once for them, and the questions of one document, however many, are as many tasks' work as they fill.
    """
    columns = questions.columns
    rows = questions.withColumn("_asked", strip(F.coalesce("question", F.lit("")))).withColumn("_words", F.array_sort(F.array_distinct(query_words(F.col("_asked")))))
    sets = rows.where("doc_id is not null and _asked != ''").select("doc_id", "_words").distinct()
    many = sets.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_groups"))
    dealt = sets.join(many, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("_words"), F.col("_groups")).alias("_group")).agg(F.collect_list("_words").alias("_sets"))
    texts = docs.where("text != ''").select("doc_id", F.col("text").alias("_text"))
    met = dealt.join(texts, "doc_id").select("doc_id", "_sets", raw_lines(F.col("_text")).alias("_lines"))
    found = F.transform("_sets", lambda ws: F.struct(ws.alias("_words"), F.transform(F.slice(F.filter("_lines", lambda s: _holds(s, ws)), 1, top), strip).alias("_found")))
    hits_ = met.select("doc_id", F.explode(found).alias("h")).select("doc_id", "h._words", "h._found")
    out = rows.join(hits_, ["doc_id", "_words"], "left")
    return _judged(out, F.col("_found"), F.col("_found").isNotNull()).select(*columns, "ok", "answer")
