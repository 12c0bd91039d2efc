"""The training-data pipeline: five operators of textloom.llm, one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, exact_dedup, language, near_dedup, packing
from textloom.llm.common import forget_all, materialise, table, without
from textloom.llm.queries import tokenizer

#: DuckDB SQL for the rows of run(): none, as language ID, MinHash and packing can't be said in SQL.
ORACLE_SQL: str | None = None

# Rows are told apart by doc_id and text: rows without a doc_id, and rows that repeat one with another text, go through
# every stage by their own text. Near-dedup needs ids to name documents: rows without one stay there. A null text
# counts as empty. No documents give no rows.


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, empty, without letters) go; mixed ones stay."""
    return language.identify(docs, carry=True).filter("lang_pred <> 'und'").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays."""
    return exact_dedup.distinct_texts(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays."""
    return without(docs, near_dedup.near_dedup(docs).filter("NOT kept AND doc_id IS NOT NULL"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), rows=True).filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        forget_all(spark, docs)  # the stage's own intermediate tables, and the one before
    return STAGES[-1][1](spark, docs, sf_dir)
