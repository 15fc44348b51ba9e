"""From raw documents to packed sequences: quality rules, near-dedup, substring dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import neardup, packing, quality, substrings
from pagewright.llm.shared import written
from pagewright.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fail none of the full policy's rules, by their failure bits.

    Null and empty texts have too few words; repeated rows stay or go together; very long texts are measured whole.
    """
    return quality.passing(docs, quality.FULL)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group: five words to a shingle, similarity 0.8.

    Rows without words stay; of rows that repeat, or have no doc_id, one stays of each group too.
    """
    return neardup.one_of_each(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts less every window of 35 words that recurs, and their lengths anew.

    A null text stays null; a text that is nothing but copies becomes empty and stays a row.
    """
    return substrings.without_repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 4096 tokens; a null or empty text is a piece of one token."""
    return packing.pack(packing.pieces(docs, tokenizer_path(), end_id=1))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Packing and near-dedup by these methods have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on all of documents, each one's result written and read again for the next.

    An empty table passes through all of them. Columns of any name are kept as they are by all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
