"""Training-data pipeline over `documents`: each stage is one operator, written as Parquet and read by the next.

Null and empty texts are documents like any other, as are repeated rows, unless a stage says otherwise; further columns
pass through all stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecmesh.llm import line_dedup, ngram_join, packing, quality, secrets
from vecmesh.llm.common import stored
from vecmesh.llm.entries import tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score the quality threshold or more; labels train the trees, held-out ids excluded.

    Null and empty texts are scored as empty ones; without usable labels all documents score 0.5 and stay.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs across documents, and without long lines that do.

    A document of which such long lines are most is a copy; it stays whole for the next stage, which drops copies.
    Rows that repeat count as documents of their own; no row is left out.
    """
    return line_dedup.remove(docs, spare_copies=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id; of repeated rows the first.

    Documents without words, null texts included, are similar to nothing and all stay.
    """
    return ngram_join.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; texts without any stay as they are, null ones null."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", classify), ("lines", drop_lines), ("near_copies", drop_near_copies), ("secrets", hide_secrets), ("packing", pack)]

#: Trained trees and connected components have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
