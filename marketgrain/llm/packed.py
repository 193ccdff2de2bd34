"""Shards of texts, and sorted numbers as compact bytes to send between shards and hash slots.

Some operators ask, for every word sequence of a shard, how often the whole corpus holds it. A shard names each
sequence by a *bin*, the leading bits of its 64-bit hash, sends its distinct bins to hash slots, and gets the slots'
answers back. Bins are sent sorted, as differences in compressed byte planes: one to four bytes each instead of a
row. A sequence that a third of all documents hold is one bin per shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = struct.Struct("<qQb")


def pack(values: np.ndarray) -> bytes:
    """Numbers (uint64) in as many byte planes as the largest needs."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _HEAD.pack(len(values), 0, width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    count, _, width = _HEAD.unpack_from(data)
    body = pa.decompress(data[_HEAD.size :], decompressed_size=count * width, codec="zstd", asbytes=True)
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, count).T
    return out.view("<u8").reshape(count)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers (uint64) by their differences."""
    if not len(values):
        return pack(values)
    data = pack(np.diff(values))
    count, _, width = _HEAD.unpack_from(data)
    return _HEAD.pack(count, int(values[0]), -width) + data[_HEAD.size :]


def unpack_sorted(data: bytes) -> np.ndarray:
    count, first, width = _HEAD.unpack_from(data)
    if width > 0:
        return unpack(data)
    steps = unpack(_HEAD.pack(count, 0, -width) + data[_HEAD.size :])
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(steps, dtype=np.uint64)]).astype(np.uint64)


def bin_bits(text_bytes: int, spare: int = 4) -> int:
    """Bits of a bin, so that few of the corpus' sequences share one: there are fewer sequences than bytes."""
    return min(64, max(8, int(text_bytes).bit_length() + spare))


def slot_edges(bits: int, slots: int) -> np.ndarray:
    """The first bin of every slot but the first; slots are ranges of bins."""
    return np.array([((s << bits) + slots - 1) // slots for s in range(1, slots)], np.uint64)


def by_slot(bins: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``slot, start, end`` of the slots that ascending ``bins`` reach."""
    cuts = np.concatenate([[0], np.searchsorted(bins, edges), [len(bins)]]).astype(np.int64)
    for slot in np.flatnonzero(np.diff(cuts)).tolist():
        yield slot, int(cuts[slot]), int(cuts[slot + 1])


def summed(values: np.ndarray, weights: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, with the sum of their weights; ``runs``: the values are ascending runs."""
    if not len(values):
        return values, weights
    order = np.argsort(values, kind="stable" if runs else None)
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[starts], np.add.reduceat(weights, starts)


_SPREAD, _TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), 22


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a value is one of the ascending ``keys``; a small table rules out most others first."""
    found = np.zeros(len(values), bool)
    if not len(keys) or not len(values):
        return found
    slot = np.uint64(64 - _TABLE_BITS)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(keys * _SPREAD) >> slot] = True
    maybe = np.flatnonzero(table[(values * _SPREAD) >> slot])
    at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
    found[maybe] = keys[at] == values[maybe]
    return found


def _folded_rows(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(columns).aggregate([([], "count_all")])
            yield from counted.rename_columns([*columns, "copies"]).to_batches()

    return run


def dealt_texts(texts: DataFrame, shards: int) -> DataFrame:
    """``texts``, equal rows of a batch folded to one with the number of ``copies``, dealt to ``shard``.

    A text that many rows hold is one row per batch in the shuffle.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    folded = texts.mapInArrow(_folded_rows(texts.columns), f"{schema}, copies bigint")
    key = F.pmod(F.xxhash64(*texts.columns), F.lit(shards)).cast("int")
    return folded.withColumn("shard", key).repartition("shard")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
