"""Near copies by exact similarity: prefix keys, bounded cells, verified links, connected groups.

Two texts are near copies when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
Words are those of the fingerprints: ASCII letters fold to lower case, ASCII white space separates. Texts of
fewer words are one shingle, their whole word sequence; a text without words has the empty set.

Equal sets are one node. Of a set's n shingles in one order for all sets, two near copies share one of the first
n // 5 + 1, so nodes meet under those as keys and no pair is missed. Shingles that many documents of a sample
hold come last in the order, which keeps common passages out of the keys; the result doesn't depend on them.

Links are found twice. First the nodes of a few keys each are compared with one node of the key, which joins
large groups. Then all nodes of a key that are in different groups meet in square cells, where sizes and a
parity sketch rule out pairs: bits that differ bound the shingles that differ. Every pair left is compared by
its shingles, read again from the texts. Sets and shingles are equal by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import by_bytes, mixed, rolling, stored, word_table
from marketgrain.llm.simhash import components

SHINGLE = 5
#: Keys under which a node is compared with one other.
LEAD = 2
#: Nodes compared with each other in one step.
CELL = 2048
#: One document of so many is read for common shingles; so many of these documents make one common; most common ones kept.
SAMPLED, COMMON, COMMON_KEPT = 64, 20, 100_000

_SKETCH = 1024


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = word_table(texts, fold=True)
    rolled, starts = rolling(words.hashes, SHINGLE), words.starts.tolist()
    sets = []
    for a, b in zip(starts, starts[1:]):
        if 0 < b - a < SHINGLE:
            sets.append(rolling(words.hashes[a:b], b - a) + np.uint64(b - a))
        else:
            sets.append(np.unique(rolled[a : max(a, b - SHINGLE + 1)]))
    return sets


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set."""
    return mixed(np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)).view(np.int64)


def _sketch(shingles: np.ndarray) -> bytes:
    bits = np.bincount((shingles & np.uint64(_SKETCH - 1)).astype(np.int64), minlength=_SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _set_rows(sent):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: np.ndarray = sent.value
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            sets = shingle_sets(batch["text"])
            keys = []
            for s in sets:
                late = np.isin(s, common)
                keys.append(np.concatenate([s[~late], s[late]])[: len(s) // 5 + 1].view(np.int64))
            columns = [
                batch["doc_id"],
                pa.array(_nodes(sets), pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array([_sketch(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in by_bytes(whole, "text")):
        sets = shingle_sets(batch["text"])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])


def common_shingles(rows: DataFrame, sampled: int = SAMPLED, common: int = COMMON) -> np.ndarray:
    """Shingles that many documents of a sample hold, sorted."""
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sampled)) == 0).select("text")
    counts = some.mapInArrow(_shingle_rows, "shingle bigint").groupBy("shingle").count().where(F.col("count") >= common)
    most = counts.orderBy(F.desc("count"), "shingle").limit(COMMON_KEPT).select("shingle").toArrow()
    return np.sort(most["shingle"].to_numpy().view(np.uint64))


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in by_bytes(whole, "text")):
        sets = shingle_sets(batch["text"])
        shingles = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets), pa.int64()), shingles], ["node", "shingles"])


def _verified_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(9 * both >= 4 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes that are near copies."""
    pairs = stored(pairs.distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(sets.select("node", "least_doc").join(ends, "node"), "near-ends")
    ids = needed.where("least_doc IS NOT NULL").select(F.col("least_doc").alias("doc_id")).distinct()
    texts = rows.join(ids, "doc_id", "left_semi").select("text").unionByName(rows.where("doc_id IS NULL").select("text"))
    read = texts.mapInArrow(_text_rows, "node bigint, shingles binary").join(needed.select("node"), "node", "left_semi")
    known = stored(read.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-shingles")
    left = known.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return met.mapInArrow(_verified_rows, "a bigint, b bigint")


def _met(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows of equal cell (sorted) and different group that may be near copies."""
    cell, node, group, n = (rows[c].to_numpy() for c in ("cell", "node", "root", "n"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(node), _SKETCH // 64)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    here = np.arange(len(node))
    for lag in range(1, len(node)):
        here = here[here + lag < len(node)]
        here = here[cell[here] == cell[here + lag]]
        if not len(here):
            break
        there = here + lag
        alike = (group[here] != group[there]) & (5 * np.minimum(n[here], n[there]) >= 4 * np.maximum(n[here], n[there]))
        a, b = here[alike], there[alike]
        differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        close = 9 * differ <= n[a] + n[b]
        out_a.append(node[a[close]])
        out_b.append(node[b[close]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = _met(pa.Table.from_batches(parts))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list[pa.RecordBatch] = []  # the cell that the last batch ended in
    for batch in batches:
        g = batch["cell"].to_numpy()
        if not len(g):
            continue
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        if cut or (held and held[-1]["cell"][-1].as_py() != g[0]):
            yield pairs([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pairs(held)


def _cells(keyed: DataFrame, cell: int) -> DataFrame:
    """``cell, node, root``: rows of one cell are to be compared; any two rows of a key share a cell."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    joined = keyed.join(sizes.where("low != high").select("key", "size"), "key")
    joined = joined.withColumn("parts", F.ceil(F.col("size") * 2 / F.lit(cell)).cast("bigint"))
    whole = F.col("size") <= cell
    joined = joined.withColumn("own", F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), "parts")))
    other = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = joined.select("key", "node", "root", "own", F.explode(other).alias("other"))
    place = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return spread.select(place.alias("cell"), "node", "root")


def groups(docs: DataFrame, cell: int = CELL, sampled: int = SAMPLED, common: int = COMMON) -> DataFrame:
    """``node, least_doc, root`` of every distinct set; equal roots are one group of near copies."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, sampled, common))
    schema = "doc_id bigint, node bigint, n bigint, keys array<bigint>, sketch binary"
    found = stored(rows.mapInArrow(_set_rows(sent), schema), "near-rows")
    firsts = [F.min("doc_id").alias("least_doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")]
    sets = stored(found.groupBy("node").agg(*firsts), "near-sets")
    postings = found.select("node", F.posexplode("keys").alias("place", "key"))
    several = stored(postings.groupBy("key").count().where("count > 1").select("key"), "near-several")
    shared = stored(postings.join(several, "key").distinct(), "near-keys")

    lead = shared.where(F.col("place") < LEAD).select("key", "node")
    centre = lead.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("b"))
    pairs = lead.join(centre, "key").where("node != b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    size_a = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    size_b = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    alike = F.least("n_a", "n_b") * 5 >= F.greatest("n_a", "n_b") * 4
    pairs = pairs.distinct().join(size_a, "a").join(size_b, "b").where(alike).select("a", "b")
    first = stored(_verified(pairs, sets, rows), "near-links")
    root = components(first, "near-groups")
    keyed = shared.select("key", "node").join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    met = _cells(keyed, cell).join(sets.select("node", "n", "sketch"), "node")
    dealt = met.select("cell", "node", "root", "n", "sketch").repartition("cell").sortWithinPartitions("cell", "node")
    second = _verified(dealt.mapInArrow(_met_rows, "a bigint, b bigint"), sets, rows)
    grouped = components(first.unionByName(second), "near-groups")
    return sets.join(grouped, "node", "left").select("node", "least_doc", F.coalesce("root", "node").alias("root"))


def first_of_each_group(docs: DataFrame, **options: int) -> DataFrame:
    """The document with the least id of every group, and documents without an id."""
    least = groups(docs, **options).groupBy("root").agg(F.min("least_doc").alias("doc_id"))
    stay = least.where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.where(F.col("doc_id").isNull()).unionByName(docs.join(stay, "doc_id", "left_semi"))
