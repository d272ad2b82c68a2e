"""Corpus pipeline over the documents table: each stage is one operator of lodestream.llm.

All stages but the last return the columns of their input.  Language identification lets go of
documents without letters, without a main language or unlike all learned languages; line
deduplication cuts repeated chunks of lines out of the texts, and drops documents of which no word
is left; SimHash keeps the document of each group of near copies that has the smallest id;
decontamination drops documents that hold a benchmark passage; SentencePiece encoding adds token
ids with proof that they decode to the text.

Defined results: documents with a null or empty text have no letter, so the first stage drops
them; rows with a null id stay unless a stage drops their text; rows that repeat both id and text
stay once from the third stage on, and a different text under the same id is a document of its
own; an empty table gives an empty result; further columns are carried along, but for those with
the names that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, table
from lodestream.llm.decontaminate import drop_leaks
from lodestream.llm.langmix import keep_identified
from lodestream.llm.linechunks import drop_repeated_lines
from lodestream.llm.sentencepieces import encoded
from lodestream.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages hash with XXH64, train a model and run a tokenizer: not expressible in SQL.  The
#: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again.

    A table goes when the next one is written; the last, which the result reads, stays in the folder.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
