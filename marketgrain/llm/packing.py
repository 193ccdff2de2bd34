"""Token-id output: documents packed into rows of one context length.

Documents are dealt to shards of a few MB by their id and text. A shard cuts documents longer than the context into
whole rows and a rest, loses nothing, and places the pieces by best fit decreasing: longest first, each in
the open row whose free space is the least that holds it. A segment tree over the capacities finds that row
in the logarithm of the context length. A shard is held whole, so neither copies nor long documents load a
task beyond a shard and one document; many shards share one partition of the shuffle. The rows depend only on
the ids and texts.

Ties go by document id, then by position in the document; among rows of equal free space the latest is
filled first. Null and empty texts have no tokens and appear in no row. Documents with a null id are packed
too. Rows that repeat an id are packed each and spread over shards by their text; equal rows share a shard.
Texts may have runs of white space of any length. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import row_key, shard_count
from marketgrain.llm.tokens import encode

CONTEXT = 2048
#: Id that fills the end of a row; the vocabulary's own ids end before it.
PADDING = 50256
SHARD_BYTES = 4 << 20


class FreeSpace:
    """Open rows by free space, in a segment tree whose leaves are the capacities 0 to ``most``."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)  # whether a subtree has an open row
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = free + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free space of at least ``need``, removed, and that space."""
        node = need + self.size
        while not self.any[node]:
            while node & 1:  # a right child: what is larger lies beyond its parent
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        free = node - self.size
        row = self.rows[free].pop()
        if not self.rows[free]:
            self.any[node] = 0
            while node > 1:
                node //= 2
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
        return row, free


def best_fit(lengths: list[int], context: int) -> list[list[int]]:
    """Rows of piece numbers; ``lengths`` lie between 1 and ``context``."""
    rows: list[list[int]] = []
    space = FreeSpace(context)
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        found = space.take(lengths[piece])
        if found is None:
            rows.append([])
            found = len(rows) - 1, context
        row, free = found
        rows[row].append(piece)
        if free > lengths[piece]:
            space.put(free - lengths[piece], row)
    return rows


_SEGMENT = pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32())])
_PACKED = pa.schema(
    [
        ("shard", pa.int32()),
        ("row", pa.int32()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("resets", pa.list_(pa.int32())),
        ("segments", pa.list_(_SEGMENT)),
    ]
)


def _packed_rows(path: str, context: int, padding: int):
    def run(docs: pa.Table) -> pa.Table:
        encoded = encode(path)
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        pieces = []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
            ids = np.array(encoded(text), "<u2") if text else np.zeros(0, "<u2")
            pieces += [(doc_id, at, ids[at : at + context]) for at in range(0, len(ids), context)]
        out: list[list] = [[] for _ in _PACKED]
        for number, row in enumerate(best_fit([len(ids) for _, _, ids in pieces], context)):
            parts = [pieces[p] for p in row]
            ends = np.cumsum([0, *(len(ids) for _, _, ids in parts)]).tolist()
            body = np.full(context, padding, "<u2")
            body[: ends[-1]] = np.concatenate([ids for _, _, ids in parts])
            segments = [{"doc_id": d, "offset": at, "length": len(ids)} for d, at, ids in parts]
            shard = docs["shard"][0].as_py()
            for column, value in zip(out, (shard, number, ends[-1], body.tobytes(), ends, ends[:-1], segments)):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PACKED)], schema=_PACKED)

    return run


def pack(
    docs: DataFrame, path: str, context: int = CONTEXT, padding: int = PADDING, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per packed row.

    ``ids`` holds ``context`` little-endian 16-bit ids; ``cu_seqlens`` the cumulative lengths of the
    segments from 0 to ``n_tokens``, ``resets`` the places where positions start again at 0, and
    ``segments`` the document, offset in it and length of each.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    shards = shard_count(docs, "text", shard_bytes)
    dealt = docs.withColumn("shard", F.pmod(row_key(), F.lit(shards)).cast("int")).repartition("shard")
    return dealt.groupBy("shard").applyInArrow(
        _packed_rows(path, context, padding),
        "shard int, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
        "segments array<struct<doc_id:bigint,offset:bigint,length:int>>",
    )


def write_matrices(packed: DataFrame, folder: str, shards: int = 64) -> None:
    """Write the rows as parquet, a folder per range of ``shards`` shards, in shard and row order.

    Each file's ``ids`` is an id matrix; a folder holds a few hundred MB at the default sizes.
    """
    ranged = packed.withColumn("shards", F.floor(F.col("shard") / F.lit(shards)).cast("int"))
    ranged.repartition("shards").sortWithinPartitions("shards", "shard", "row").write.partitionBy("shards").parquet(folder)
