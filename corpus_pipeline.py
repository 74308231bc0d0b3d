"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

What holds for all stages: other columns, of any name, are kept by all but the last; an empty table gives an empty table;
very long texts are read whole; rows with a null doc_id are rows like any other. What each makes of null and empty texts,
ties and repeated rows stands at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, near_dup, packing, pii, quality
from scriptorium.llm.common import materialize, table

#: The key of the surrogates in this sample pipeline; a real one comes from a secret store.
KEY = "sample-key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go.

    Null and empty texts have too few words and go; repeated rows are judged alike, and all stay or go.
    """
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, one without a doc_id only where the whole group has none; of repeated rows (ties in all of
    id and text) one stays. Texts without words are linked with nothing and all stay, but for repeats of id and text.
    """
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go.

    Texts without words share nothing and stay; repeated rows are judged alike.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to surrogates; n_chars, where there is one, follows the new text.

    A null text stays null, with a null n_chars; repeated rows change alike.
    """
    out = pii.replace_pii(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its place there.

    Null and empty texts are one piece with the end token alone; repeated rows are packed once each.
    """
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("packing", packed),
]

#: Near-duplicate groups, surrogates and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
