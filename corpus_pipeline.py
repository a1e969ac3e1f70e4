"""A training corpus from `documents`: good texts, one of each group of near copies, without repeated passages, packed.

STAGES are applied in order; each one's result is written and read again as the next one's input. A null or empty table
goes through; what the stages do with odd rows is said in their modules.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import near_dups, packing, quality, suffix_dedup
from ledgerloom.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by `labels`, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five words, 0.8). Rows of one doc_id are
    one document: they stay or go together. Those without a doc_id stay."""
    found = near_dups.near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("copy")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["copy"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has too."""
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Encoding and the linear program are beyond SQL.
ORACLE_SQL = None
