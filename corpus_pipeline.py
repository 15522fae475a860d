"""A corpus pipeline of five stages; each reads what the one before wrote and returns what the next one reads.

All but the last return the columns of ``documents``; the last returns the packed pieces with their ids.

Defined cases: null text is empty and, as a text without words, rejected by the first stage; rows that repeat are one group of
copies for the third; long texts are processed whole; other columns go along up to the last stage; an empty table gives no
piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import chosen_path, line_dedup, packing, quality, repeats
from recollect.plans.shared import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in the last one only."""
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return chosen_path.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that occur elsewhere too go."""
    return repeats.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of powers of two."""
    return packing.packed(docs, packing.tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written to the shared folder, so that the passes of the next one don't repeat it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if n else docs, sf_dir)
    return docs


#: The chain has no SQL form (suffix intervals, token merges); tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None
