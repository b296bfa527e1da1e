"""A corpus in five stages: toxicity, near-duplicates, repeated passages, test items, packing.

Each stage takes the documents that the stage before kept and returns them with the columns of
``documents``; the last returns what ``op7`` returns, a row for each packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.decontaminate import drop_contaminated
from wordloom.llm.near_dup import drop_near_duplicates
from wordloom.llm.packing import pack_documents
from wordloom.llm.queries import tokenizer_file
from wordloom.llm.substring import dedup_substrings
from wordloom.llm.toxicity import drop_toxic
from wordloom.session import Scratch, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict toxic, all columns kept.

    Null and empty texts score as texts without a known word, so they stay; texts are read whole. Repeated rows
    are judged alike and all stay or go. An empty table stays empty; without labels the voters' own model decides.
    """
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the least by id and then by a hash of the text, all columns kept.

    Null and empty texts, and texts without words, have no duplicates and all stay. Rows that repeat an id and a
    text leave one, the first by a hash of its columns. An empty table stays empty.
    """
    ship(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated passages; n_chars is counted again where the text changed.

    Null, empty and short texts stay as they are, and so do texts that lose nothing, to the character. Every occurrence
    of a repeated passage goes, so rows that repeat a long text lose it. An empty table stays empty.
    """
    ship(spark)
    return dedup_substrings(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item, all columns kept.

    Null and empty texts hold no item and stay; texts are read whole; repeated rows all stay or all go. Null and empty
    items are found nowhere. Without documents or items the documents stay as they are.
    """
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences, a row for each piece.

    Null and empty texts hold the end id alone; long ones are cut; repeated rows are packed once each; pieces of equal
    length go by the checksum of their ids, then by their start. An empty table gives no rows.
    """
    ship(spark)
    return pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models, similarity joins and a tokenizer are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
