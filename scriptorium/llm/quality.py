"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bits are the
failed rules; policies are versioned masks over these bits, and ablations are sums over the (few) distinct masks.

Defined results: null or empty text has no words and fails the length rule; very long texts are measured whole; repeated rows are judged alike and
kept apart; an empty table gives an empty ledger; all columns of the input may be carried along, and where one has
a name of the ledger's, the ledger's own columns win.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    # str.split would also split at other Unicode spaces; the six ASCII ones separate words here
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, n_lines, n_dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_dup, repeated_words(words), n_lines


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    often = {w for w, n in Counter(windows).items() if n > 1}
    if not often:
        return 0
    starts = [i for i, w in enumerate(windows) if w in often]
    return width + sum(min(width, b - a) for a, b in pairwise(starts))


def _n(name: str) -> Column:
    return F.col(name)


#: Rules by bit: a name and when a document fails. Bits are never given to another rule.
RULES: tuple[tuple[str, Column | object], ...] = (
    ("too_few_words", lambda: _n("n_words") < 50),
    ("repeated_windows", lambda: 100 * _n("n_repeat_words") > 50 * _n("n_words")),
    ("symbols", lambda: 10 * _n("n_symbols") > _n("n_words")),
    ("duplicate_lines", lambda: (_n("n_lines") >= 4) & (10 * _n("n_dup_lines") > 3 * _n("n_lines"))),
    ("short_words", lambda: _n("word_chars") < 2 * _n("n_words")),
    ("long_words", lambda: _n("word_chars") > 20 * _n("n_words")),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the bits that reject a document.
POLICIES = {
    1: BIT["too_few_words"] | BIT["repeated_windows"],
    2: BIT["too_few_words"] | BIT["repeated_windows"] | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
}
CURRENT_POLICY = 2


def ledger(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per document: the kept columns, the measurements and failed_bits."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in (*MEASURES, "failed_bits")]
    source = docs.select(*keep, *([] if text in keep else [text]))
    own = [f for f in source.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + "".join(f", {m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(text)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *columns], names=[*(f.name for f in own), *MEASURES])

    measured = source.mapInArrow(run, schema)
    bits = F.lit(0)
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured.withColumn("failed_bits", bits)


def passes(policy: int = CURRENT_POLICY) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def accepted(docs: DataFrame, policy: int = CURRENT_POLICY) -> DataFrame:
    """The rows, with all their columns, that a policy lets pass; the input's names cannot clash with the ledger's."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    book = ledger(plain, plain.columns, plain.columns[docs.columns.index("text")])
    return book.where(passes(policy)).select(plain.columns).toDF(*docs.columns)


def ablation(book: DataFrame, policy: int = CURRENT_POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that fail it alone (which dropping the rule would keep).

    Works on the counts of distinct masks: at most 2 ** rules rows, whatever the corpus.
    """
    masks = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])).alias("mask")).count()
    rules = book.sparkSession.createDataFrame([(n, b) for n, b in BIT.items() if b & POLICIES[policy]], "rule string, bit int")
    hit = F.col("mask").bitwiseAND(F.col("bit"))
    return (
        masks.join(F.broadcast(rules), hit != 0, "right")  # a row for each rule
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("mask") == F.col("bit"), F.col("count"))), F.lit(0)).alias("n_only_this"),
        )
    )
