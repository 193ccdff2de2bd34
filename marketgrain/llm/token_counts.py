"""Token counts from the exact histogram of encoded lengths.

Texts are encoded once; documents are folded to one row per length, first inside each task, so a length
that most documents have is one row per task in the shuffle. Suffix sums over the lengths then answer, for
every context limit, how many documents exceed it, how many tokens there are and how many a cut at the
limit keeps. Lengths fall into blocks of ``BLOCK``; sums run inside a block and over the blocks' totals, so
no task holds all lengths.

Null and empty texts have zero tokens and count as documents; rows that repeat an id count each. Texts may have
runs of white space of any length. Only the column ``text`` is read, so other columns may have any name. An empty
table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.common import stored
from marketgrain.llm.tokens import encode

BLOCK = 256


def _length_rows(path: str):
    schema = pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encode(path)
        for batch in batches:
            lengths = np.array([len(ids(text)) if text else 0 for text in batch["text"].to_pylist()], np.int64)
            sizes, counts = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(counts.astype(np.int64))], schema=schema)

    return run


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """``n_tokens, n_docs`` for every encoded length that occurs."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_length_rows(path), "n_tokens bigint, n_docs bigint")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length, read as a context limit.

    ``docs_over`` have more tokens than the limit, ``docs_within`` at most as many; ``tokens_within`` are
    the tokens of the latter, ``tokens_kept`` what is left of all documents cut at the limit and
    ``tokens_lost`` the rest; ``share_within`` is the quantile of the limit.
    """
    histogram = stored(histogram, "lengths")  # read twice below; the texts are encoded once
    blocked = histogram.withColumn("block", F.floor(F.col("n_tokens") / F.lit(block)))
    sums = [F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("block_tokens")]
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = (
        blocked.groupBy("block")
        .agg(*sums)
        .select(
            "block",
            F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("later_docs"),
            F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("later_tokens"),
            F.sum("block_docs").over(everything).alias("docs"),
            F.sum("block_tokens").over(everything).alias("tokens"),
        )
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    suffix = (
        blocked.join(blocks, "block")
        .withColumn("docs_over", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("later_docs"))
        .withColumn(
            "tokens_over",
            F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0)) + F.col("later_tokens"),
        )
    )
    kept = F.col("tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    return suffix.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_over",
        (F.col("docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("tokens") - F.col("tokens_over")).alias("tokens_within"),
        kept.alias("tokens_kept"),
        (F.col("tokens") - kept).alias("tokens_lost"),
        ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("share_within"),
    )


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents don't exceed."""
    return limits.where(F.col("share_within") >= share).agg(F.min("context_limit").alias("n_tokens"))
