"""Documents to clean, deduplicated, decontaminated token ids: a chain of five corpus operators.

``run`` writes each stage's result to the shared folder and reads it again for the next stage.

Every stage takes any columns beside ``doc_id`` and ``text``, under any name, and returns them unchanged. A null
text is an empty one and stays null. Rows without an id are judged by their text: none of their lines goes, a
benchmark passage in them does, and of near-duplicates they are the last to stay. Rows that repeat an id are one
document for the lines and are judged each elsewhere; of a group, the least id stays, and rows equal in id and
text stay or go together. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from marketgrain.llm.common import stored, table
from marketgrain.llm.queries import MERGES


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; a text too short for the rules, null and empty ones too, goes."""
    return quality_rules.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document of smaller id holds; equal lines of one document all stay."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    judged = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in other]).alias("given")))
    columns = {c: F.col("given").getField(c) for c in other} | {"doc_id": F.col("doc_id")}
    columns["text"] = F.when(F.col("text").isNotNull(), F.col("kept"))
    if "n_chars" in other:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(columns["n_chars"])
    return judged.select(*[columns[c].alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: fingerprints of three-word shingles at most three bits apart."""
    return simhash.first_of_each_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item, all of their copies judged alike."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text decoded from them; no ids and an empty text for null."""
    return bpe.encode_and_decode(docs, MERGES)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Fingerprints and BPE have no SQL; the chain is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-stage-{number}")
    return docs
