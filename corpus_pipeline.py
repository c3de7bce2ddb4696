"""Corpus pipeline: documents -> clean, deduplicated, decontaminated and encoded documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read back as the next stage's docs. All but the last return the columns of ``documents``.

In every stage an empty table gives no rows, texts of any length are read whole, repeated rows fare alike, and columns
other than doc_id, text and lang pass through untouched under any name. What nulls and ties give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontam, langid, linededup, neardup
from larkspur.llm.queries import BPE_VOCABULARY, table
from larkspur.llm.runtime import forget, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text is in a learned language; the others go.

    Null, empty and letterless texts go; a null lang is not learned from; of languages that tie the last by name wins.
    """
    return langid.keep_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three documents or more hold, but for the last document's.

    Null text becomes empty; a row without an id loses every such line and keeps none; lines of one document only stay.
    """
    return linededup.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates.

    Documents without a word and rows without an id stay; a pair at the threshold of 0.8 is linked.
    """
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``.

    Null text is clean; null and empty items are not looked for; an overlap at the limit of 80 % counts.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the token ids and of the text decoded from them.

    Null text is encoded as empty; of equal merge ranks the leftmost goes first; a null doc_id stays null.
    """
    return bpe.digest_documents(docs, BPE_VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No SQL: language models, byte-pair merges and component search have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
