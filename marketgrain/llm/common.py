"""Reading, durable cut points and word arrays shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text hashed at once; bounds the scratch arrays, not the texts.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only in local mode where none is set, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marketgrain-llm-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    ``rows_per_file`` bounds what a task reads at once where rows are wide; zero sets no bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by_key(df: DataFrame, name: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Write ``df`` once, a bucket of its keys per file, sorted; read as buckets, and as plain files.

    The number of buckets is that of the session's shuffle partitions, so a join of the buckets on all keys meets a
    side that is dealt by them where it lies: nothing of the written side is shuffled again.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = f"{name}-{uuid.uuid4().hex}"
    path, table_name = f"{shared_folder(spark)}/{unique}", unique.replace("-", "_")
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table_name, format="parquet")
    return spark.table(table_name), spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key() -> Column:
    """A number for a row by its id and text; rows without an id differ by their text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def whole_rows(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that working columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def given_columns(docs: DataFrame, held: str) -> list[Column]:
    """The columns of ``docs`` out of the column ``held`` made by ``whole_rows``."""
    return [F.col(held).getField(c).alias(c) for c in docs.columns]


def shard_count(docs: DataFrame, column: str, shard_bytes: int) -> int:
    """Shards of about ``shard_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)).cast("bigint"))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def shard_of(doc_id: Column, text: Column, shards: int) -> Column:
    """The shard of a document by its id; documents without an id spread by their text."""
    key = F.xxhash64(doc_id, F.when(doc_id.isNull(), text))
    return F.pmod(key, F.lit(shards)).cast("int")


class WordTable(NamedTuple):
    """Words of many texts one after another."""

    hashes: np.ndarray  # uint64 per word
    text: np.ndarray  # index of the word's text
    starts: np.ndarray  # first word of each text, and the number of words


def _byte_tables(fold: bool, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    separator = np.zeros(256, bool)
    separator[[9, 10, 11, 12, 13, 32]] = True
    if punctuation:
        for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
            separator[low : high + 1] = True
    code = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        code[65:91] = code[97:123]
    return separator, code


_TABLES = {(f, p): _byte_tables(f, p) for f in (False, True) for p in (False, True)}


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, base, np.uint64) for base in (_BASE, _BASE_INVERSE))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of polynomial hashes over all bits."""
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _slice_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, code: np.ndarray, prefix: int | None = None):
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if prefix is not None:
        ends = np.minimum(ends, starts + prefix)
    size = len(data) if len(data) > 2 * SLICE_BYTES else 2 * SLICE_BYTES
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


def word_table(
    texts: pa.Array, fold: bool = False, punctuation: bool = False, prefix: int | None = None
) -> WordTable:
    """64-bit hashes of the words of ``texts``, or of their first ``prefix`` bytes; a null text has none.

    Words are runs without the six ASCII white-space bytes. ``punctuation`` makes ASCII punctuation and
    control bytes separators too, ``fold`` gives A-Z the hashes of a-z.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    separator, code = _TABLES[fold, punctuation]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    hashes, counts, at = [], [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        local = offsets[at : to + 1] - offsets[at]
        part, bounds = _slice_words(data[offsets[at] : offsets[to]], local, separator, code, prefix)
        hashes.append(part)
        counts.append(np.diff(bounds))
        at = to
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return WordTable(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), counts), starts
    )


class PieceWords(NamedTuple):
    """Words of many texts one after another, with the piece of text that each lies in."""

    hashes: np.ndarray  # uint64 per word
    text: np.ndarray  # index of the word's text
    piece: np.ndarray  # number of the word's piece; pieces don't reach into another text
    begins: np.ndarray  # first byte of each word in ``data``
    ends: np.ndarray
    data: np.ndarray  # bytes of all texts


#: Bytes that end a piece of text: . , ; : ! ? and line ends.
_PIECE_ENDS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_PIECE_SEPARATORS = _PIECE_ENDS | np.isin(np.arange(256), [0x20, 0x09])


def piece_words(texts: pa.Array) -> PieceWords:
    """64-bit hashes of the words between spaces, tabs and piece ends, A-Z folded; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    code = _TABLES[True, False][1]
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    at = pieces = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        part, local = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        hashes, bounds = _slice_words(part, local, _PIECE_SEPARATORS, code)
        inside = ~_PIECE_SEPARATORS[part]
        border = np.zeros(len(part) + 1, bool)
        border[local] = True
        begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])[: len(part)] | inside & border[:-1])
        ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])[: len(part)] | inside & border[1:]) + 1
        cuts = np.cumsum(_PIECE_ENDS[part] | border[:-1])
        for column, values in zip(
            found,
            (
                hashes,
                np.repeat(np.arange(at, to), np.diff(bounds)),
                cuts[begins] + pieces,
                begins + offsets[at],
                ends + offsets[at],
            ),
        ):
            column.append(values)
        pieces += int(cuts[-1]) + 1 if len(cuts) else 1
        at = to
    arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
    return PieceWords(arrays[0].astype(np.uint64), *arrays[1:], data)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` neighbours, also of those that cross texts."""
    count = max(0, len(hashes) - size + 1)
    h = np.zeros(count, np.uint64)
    for j in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += hashes[j : count + j]
    return mixed(h)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, by doubling."""
    width, low = 1, values
    while width < size:
        step = min(width, size - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return low


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of ``column``, a longer value alone."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
