"""SimHash near-dedup: pigeonhole blocks, a join on blocks, Hamming verification, connected groups.

A fingerprint has a bit set when more than half of the XXH64 hashes (seed 42) of the text's three-word
shingles have it set. Texts of fewer words hash their whole word sequence; a text without words has
fingerprint zero. Fingerprints link at three or fewer differing bits.

Of four 16-bit blocks, two fingerprints within three bits share at least one; of four 12-bit parts of the
other 48 bits they share at least one too. Each distinct fingerprint, standing for all its documents,
therefore appears under 16 keys of 28 bits, and linked fingerprints meet under a common key. A key with
more than ``CELL`` fingerprints is split into square cells that cover all its pairs, so every task
compares a bounded number. A cell compares all its pairs but reports only a forest that keeps the same
fingerprints connected: fewer links than fingerprints, however large the group.

Links are contracted by alternating large and small stars until nothing changes; the number of rounds
grows with the logarithm of the longest chain. All joins are on both sides' own shuffles, so adaptive
execution splits fingerprints that many documents share.

Null texts are empty. A document without an id belongs to its component; a component without any id has a
null ``component_id``. ``near_duplicates`` returns repeated rows each; ``first_of_each_group`` takes rows equal
in id and text for one document, and keeps one of equal rows without an id. Columns other than ``doc_id`` and
``text`` pass through and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import given_columns, row_key, stored, whole_rows

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 4
#: Fingerprints compared with each other in one step.
CELL = 4096

_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprint_rows(shingle: int, through: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch["text"]]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in through), fps], names=[*through, "fp"])

    return run


def _with_fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """The 64-bit numbers of ``rows`` and the fingerprint ``fp`` of their ``text``."""
    through = [c for c in rows.columns if c != "text"]
    return rows.mapInArrow(_fingerprint_rows(shingle, through), ", ".join(f"{c} bigint" for c in [*through, "fp"]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row, ``fp`` as a signed 64-bit number."""
    return _with_fingerprints(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), shingle)


def _block_keys() -> list[str]:
    """SQL for the key of every choice of a 16-bit block and a 12-bit part of the rest."""
    keys = []
    for block in range(BLOCKS):
        places = [b for b in range(BLOCKS) if b != block]
        rest = " | ".join(f"shiftleft(shiftrightunsigned(fp, {16 * b}) & 65535L, {16 * k})" for k, b in enumerate(places))
        head = f"shiftleft(shiftrightunsigned(fp, {16 * block}) & 65535L, 12)"
        for part in range(BLOCKS):
            tail = f"shiftrightunsigned({rest}, {12 * part}) & 4095L"
            keys.append(f"{block * BLOCKS + part}L << 48 | {head} | ({tail})")
    return keys


def cells(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """``cell, fp``: rows of one cell are to be compared; any two rows of a key share a cell."""
    keyed = nodes.select("fp", F.explode(F.array(*[F.expr(k) for k in _block_keys()])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") * 2 / F.lit(cell)).cast("bigint"))
    joined = joined.withColumn("own", F.when(F.col("n") > cell, F.pmod(F.xxhash64("fp"), "parts")).otherwise(F.lit(0)))
    other = F.when(F.col("n") > cell, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    spread = joined.select("key", "fp", "own", F.explode(other).alias("other"))
    return spread.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")


def _forest(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of equal ``group`` (sorted) whose fingerprints are close."""
    label = np.arange(len(fps))
    tree = list(range(len(fps)))

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    out_a, out_b = [], []
    here = np.arange(len(fps))
    for lag in range(1, len(fps)):
        here = here[here + lag < len(fps)]
        here = here[group[here] == group[here + lag]]
        if not len(here):
            break
        there = here + lag
        close = (label[here] != label[there]) & (np.bitwise_count(fps[here] ^ fps[there]) <= distance)
        if not close.any():
            continue
        for i, j in zip(here[close].tolist(), there[close].tolist()):
            a, b = root(i), root(j)
            if a != b:
                tree[max(a, b)] = min(a, b)
                out_a.append(i)
                out_b.append(j)
        label = np.array(tree)
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label = deeper
    return fps[out_a], fps[out_b]


def _link_rows(distance: int):
    def links(group: list[np.ndarray], fps: list[np.ndarray]):
        a, b = _forest(np.concatenate(group), np.concatenate(fps).view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps = [], []  # the cell that the last batch ended in
        for batch in batches:
            g = batch["cell"].to_numpy(zero_copy_only=False)
            f = batch["fp"].to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if cut or (group and group[-1][-1] != g[0]):
                yield links([*group, g[:cut]], [*fps, f[:cut]])
                group, fps = [], []
            group.append(g[cut:])
            fps.append(f[cut:])
        if group:
            yield links(group, fps)

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """``a, b``: links among the distinct fingerprints ``fp`` that leave the same groups connected."""
    met = cells(nodes, cell)
    dealt = met.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(_link_rows(distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the least node of the component."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), name)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        # large star: neighbours above a node move to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: neighbours below a node, and the node, move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), name)


def _rooted(nodes: DataFrame, distance: int, cell: int) -> DataFrame:
    """``nodes`` with the fingerprint ``root`` of their component."""
    grouped = components(links(nodes, distance, cell))
    joined = nodes.join(grouped, nodes.fp == grouped.node, "left")
    return joined.select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, cell: int = CELL
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``."""
    found = stored(fingerprints(docs, shingle), "fingerprints")
    placed = _rooted(found.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), distance, cell)
    named = placed.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    labels = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, cell: int = CELL
) -> DataFrame:
    """The document with the least id of every component, with the columns of ``docs``.

    Documents without an id come last in their component; one stays where the component has no other.
    """
    rows = docs.select(row_key().alias("key"), whole_rows(docs).alias("held"))
    keyed = rows.select(
        "key", F.col("held").getField("doc_id").cast("bigint").alias("id"), F.col("held").getField("text").cast("string").alias("text")
    )
    found = stored(_with_fingerprints(keyed, shingle), "fingerprints")
    order = F.struct(F.col("id").isNull(), "id", "key")
    nodes = found.groupBy("fp").agg(F.min(order).alias("least"))
    least = _rooted(nodes, distance, cell).groupBy("root").agg(F.min("least").alias("least"))
    stay = stored(least.select(F.col("least.id").alias("id"), F.col("least.key").alias("key")), "first-documents")
    known = rows.join(stay.where("id IS NOT NULL").select("key"), "key", "left_semi")
    unknown = rows.join(stay.where("id IS NULL").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return known.unionByName(unknown).select(*given_columns(docs, "held"))
