"""The registered query of every text operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm import (
    exact_dedup, fingerprints, jaccard_join, line_dedup, periodic_runs, pii, quality_ranking, quality_rules, toxicity,
    tree_bpe, vector_codes, warc,
)
from fleetsight.llm.common import held_out, source
from fleetsight.llm.packing import pack_documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(source(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 4, 2)
    labels = source(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    scored = quality_ranking.rank_quality(source(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1)
    labels = source(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(source(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(source(spark, sf_dir, "documents"), words=3, percent=90, count_links=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(source(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(source(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(source(spark, sf_dir, "documents")).drop("row")


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.all_spans(source(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(pii.KINDS))

    def count(number: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{pii.KINDS[number]}")

    counts = [count(number) for number in range(len(pii.KINDS))]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_digest(base), 256).alias("base_sha256"),
        pii.span_digest(F.col("spans")).alias("spans"),
    )


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_documents(source(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(source(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periodic_runs.planted(source(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(texts))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(source(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(source(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_ranking": op2_quality_ranking,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_index_merge": op6_warc_index_merge,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii_disclosure": op8_pii_disclosure,
    "op9_tree_bpe": op9_tree_bpe,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op6_warc_index_merge": warc.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op12_document_fingerprints": fingerprints.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
