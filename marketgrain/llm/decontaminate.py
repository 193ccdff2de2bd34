"""Benchmark decontamination by spaced-seed hashing.

Texts are compared by words: ASCII letters fold to lower case; white space and ASCII punctuation separate.
Two passages overlap when 13 consecutive words of a document agree with 13 of a test item in all but two
places at most. The 13 places fall into five blocks; each mask ignores the places of two blocks, so some
mask ignores every substitution of an overlap and its hash of the other places is equal on both sides.
Documents are scanned once against the sorted hashes of the test set, and each hit is verified word by word.

The test set is sent to all tasks in slices of at most ``SLICE_WORDS`` words. A larger one is scanned slice
by slice, with the same result. Documents are never shuffled, so copies or a frequent passage load no task
more than their own text does; the reported rows are grouped by document inside its task.

Null texts have no words. Items of fewer than 13 words can't be told from chance and match nothing. Rows
that repeat an id are reported each; equal items are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import by_bytes, given_columns, mixed, row_key, stored, whole_rows, word_table

SPAN = 13
SUBSTITUTIONS = 2
#: Words of the test set sent to the tasks at once (8 bytes a word, 80 a window for the masks' hashes).
SLICE_WORDS = 500_000

_TABLE_BITS = 22


def masks(span: int = SPAN, substitutions: int = SUBSTITUTIONS) -> list[tuple[list[range], tuple[int, ...]]]:
    """The blocks of places, and the blocks that each mask looks at."""
    blocks = substitutions + 3
    edges = [span * k // blocks for k in range(blocks + 1)]
    places = [range(a, b) for a, b in zip(edges, edges[1:])]
    return [(places, kept) for kept in combinations(range(blocks), blocks - substitutions)]


def _block_sums(hashes: np.ndarray, span: int, substitutions: int) -> list[np.ndarray]:
    count = max(0, len(hashes) - span + 1)
    sums = []
    for places in masks(span, substitutions)[0][0]:
        total = np.zeros(count, np.uint64)
        for p in places:
            total += hashes[p : p + count] * np.uint64(pow(0x9E3779B97F4A7C15, p + 1, 1 << 64))
        sums.append(total)
    return sums


def _mask_hashes(sums: list[np.ndarray], span: int, substitutions: int) -> Iterator[np.ndarray]:
    for k, (_, kept) in enumerate(masks(span, substitutions)):
        total = sums[kept[0]] + np.uint64(k)
        for block in kept[1:]:
            total = total + sums[block]
        yield mixed(total)


class TestWords:
    """The words of a slice of the test set with the hashes of all masks."""

    def __init__(self, items: pa.Table, span: int, substitutions: int) -> None:
        self.ids = items["item_id"].to_pylist()
        words = word_table(items["text"], fold=True, punctuation=True)
        self.hashes, self.text, self.starts = words
        count = max(0, len(self.hashes) - span + 1)
        whole = np.flatnonzero(self.text[:count] == self.text[span - 1 :]) if count else np.zeros(0, np.int64)
        self.tables = []
        for hashes in _mask_hashes(_block_sums(self.hashes, span, substitutions), span, substitutions):
            order = whole[np.argsort(hashes[whole], kind="stable")]
            present = np.zeros(1 << _TABLE_BITS, bool)
            present[hashes[order] >> np.uint64(64 - _TABLE_BITS)] = True
            self.tables.append((hashes[order], order, np.packbits(present)))


def _hits(words, tests: TestWords, span: int, substitutions: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of windows, of the document and of the test set, that agree but for the substitutions."""
    count = max(0, len(words.hashes) - span + 1)
    whole = words.text[:count] == words.text[span - 1 :] if count else np.zeros(0, bool)
    all_d, all_t = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for hashes, (keys, order, present) in zip(
        _mask_hashes(_block_sums(words.hashes, span, substitutions), span, substitutions), tests.tables
    ):
        if not len(keys):
            continue
        slot = hashes >> np.uint64(64 - _TABLE_BITS)
        bit = present[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        here = np.flatnonzero(whole & (bit == 1))
        low, high = np.searchsorted(keys, hashes[here], "left"), np.searchsorted(keys, hashes[here], "right")
        times = high - low
        d = np.repeat(here, times)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        t = order[np.repeat(low, times) + within]
        differ = np.zeros(len(d), np.int64)
        for p in range(span):
            differ += words.hashes[d + p] != tests.hashes[t + p]
        all_d.append(d[differ <= substitutions])
        all_t.append(t[differ <= substitutions])
    d, t = np.concatenate(all_d), np.concatenate(all_t)
    pairs = np.unique(np.stack([d, t], axis=1), axis=0) if len(d) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64())]
    + [(n, pa.int64()) for n in ("doc_start", "doc_end", "n_overlap_words", "n_equal_words", "n_item_words")]
)


def _overlap_rows(sent, span: int, substitutions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestWords = sent.value
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            words = word_table(batch["text"], fold=True, punctuation=True)
            d, t = _hits(words, tests, span, substitutions)
            ids = batch["doc_id"].to_pylist()
            rows = []
            group = words.text[d] * len(tests.ids) + tests.text[t] if len(d) else d
            order = np.argsort(group, kind="stable")
            d, t, group = d[order], t[order], group[order]
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(d) else [0]
            for a, b in zip(edges, edges[1:]):
                row, item = words.text[d[a]], tests.text[t[a]]
                inside = d[a:b, None] + np.arange(span)
                equal = words.hashes[inside] == tests.hashes[t[a:b, None] + np.arange(span)]
                start = words.starts[row]
                rows.append(
                    (
                        ids[row],
                        tests.ids[item],
                        int(d[a:b].min() - start),
                        int(d[a:b].max() + span - start),
                        len(np.unique(inside)),
                        len(np.unique(inside[equal])),
                        int(tests.starts[item + 1] - tests.starts[item]),
                    )
                )
            columns = list(zip(*rows)) or [()] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

    return run


def _slices(items: DataFrame, slice_words: int) -> Iterator[pa.Table]:
    """The test set in slices of bounded size, whole items each."""
    items = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL")
    size = F.octet_length("text") / F.lit(2) + 1  # a bound on its words
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = max(1, int(-(-2 * total // slice_words)))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        yield dealt.where(F.col("part") == part).drop("part").orderBy("item_id", "text").toArrow()


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    span: int = SPAN,
    substitutions: int = SUBSTITUTIONS,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """One row per document and test item that overlap.

    ``doc_start`` and ``doc_end`` are word positions in the document around all overlaps with the item,
    ``n_overlap_words`` the words of the document inside them, ``n_equal_words`` those that agree.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    schema = ", ".join(f"{f.name} bigint" for f in _RESULT)
    found = None
    for part in _slices(items, slice_words):
        sent = spark.sparkContext.broadcast(TestWords(part, span, substitutions))
        rows = docs.mapInArrow(_overlap_rows(sent, span, substitutions), schema)
        found = rows if found is None else found.unionByName(rows)
    return found


def without_overlaps(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The documents that overlap no test item, with the columns of ``docs``.

    Rows are judged by id and text together, so rows without an id and rows that share one are judged each.
    """
    rows = docs.select(row_key().alias("key"), whole_rows(docs).alias("held"))
    keyed = rows.select(F.col("key").alias("doc_id"), F.col("held").getField("text").alias("text"))
    hit = overlaps(keyed, items, **options).select(F.col("doc_id").alias("key")).distinct()
    hit = stored(hit, "overlaps")  # sized, so the join can choose
    return rows.join(hit, "key", "left_anti").select(*given_columns(docs, "held"))
