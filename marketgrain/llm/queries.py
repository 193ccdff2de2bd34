"""The corpus operators on the given tables, and the SQL of those that SQL can express.

Each query is a thin digest of its operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm import alignment, bpe, collocations, decontaminate, html, jaccard, line_dedup, packing
from marketgrain.llm import quality_rules, simhash, substring, token_counts, toxicity
from marketgrain.llm.common import table
from marketgrain.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

MERGES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), MERGES)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        _sha256(ids).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limit_table(token_counts.length_histogram(table(spark, sf_dir, "documents"), RANKS))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), MERGES, PIECES)
    digest = F.when(F.col("groups") == "", "").otherwise(_sha256(F.col("groups")))
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return aligned.withColumn("n_groups", F.col("n_links")).select("doc_id", *counts, digest.alias("groups_sha256"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_substring_dedup,
        op2_bpe,
        op3_decontamination,
        op4_html_extraction,
        op5_toxicity,
        op6_quality_rules,
        op7_line_dedup,
        op8_simhash,
        op9_token_counts,
        op10_token_packing,
        op11_cross_tokenizer_alignment,
        op12_ngram_jaccard_join,
        op13_phrase_collocations,
    )
}

__all__ = ["ORACLES", "QUERIES"]
