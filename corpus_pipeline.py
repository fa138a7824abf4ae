"""The corpus pipeline: quality rules, exact dedup, near dedup, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetsight.llm import exact_dedup, jaccard_join, packing, pii, quality_rules
from fleetsight.llm.common import clear_stored, source, stored

# Every stage reads what the one before it has written, so at its start it removes what that one had
# stored for itself.

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.passing(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id."""
    clear_stored(docs)
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest doc_id; five words, similarity of 0.8."""
    clear_stored(docs)
    return jaccard_join.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; every document stays."""
    clear_stored(docs)
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    clear_stored(docs)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack),
]

#: Near copies, disclosing terms and tokens are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each reads what the one before wrote as Parquet.

    Handles the same odd rows as its operators: null texts and ids, empty texts (which the first stage
    drops), repeated rows, extra columns, and an empty table, which gives no rows.
    """
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else stored(made)
    return docs
