"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification per pair.

A document's set holds its distinct five-word shingles; a text of fewer words is one shingle, its whole word
sequence, and a text without words has the empty set, which links with nothing. Words are runs without ASCII white
space, A-Z folded. Two documents link when the Jaccard similarity of their sets is at least ``percent`` / 100.

1. *Frequencies.* Texts are dealt to shards. A shard sends the bins of its shingles to hash slots, and gets back how
   many distinct texts of the corpus hold each bin that occurs twice or more. A shingle whose bin occurs once is
   *alone* and can't be shared.
2. *Prefixes.* A set's shingles are ordered rare first: by that count, then by hash. Of n shingles a partner may lack
   k = n * (100 - percent) // 100, so two linked sets share one of the first k + 1 of each. A set with more than k
   shingles alone links with nothing and ends here; of the others, only shared shingles travel.
3. *Candidates.* Sets that share a prefix shingle meet through that shingle as a key. Each set is tied to one centre
   of the key, never to all others, and the connected sets form a candidate group.
4. *Tiles.* A group is one tile, or, if it is large, its sets are dealt to blocks and every two blocks that share a
   key form a tile; a set goes only to tiles with whose blocks it shares a key. Two sets therefore meet in exactly one
   tile. There, an index of the prefixes lists the pairs that pass the length filter, each at its first common
   shingle; the positional and suffix filters bound the overlap from the two positions; the rest are verified once.
5. *Links.* A tile returns the number of links of each set and a forest that connects the linked sets, so groups of
   near copies give rows in proportion to their sets, not to their pairs.

Copies are one set throughout and are counted at the end: n sets' links are told exactly, none is capped. Counting
all links of g different near copies compares g * g / 2 pairs inside tiles, which is what the count asks for.
Memory is bounded by a shard, a slot or a tile and the longest text.

Null texts have no words. Documents without an id count as links of others, and get the least id they reach, or null.
Rows that repeat an id are documents of their own with that id. Only ``doc_id`` and ``text`` are read. An empty
table gives an empty result. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.common import by_bytes, mixed, rolling, stored, word_table
from marketgrain.llm.packed import (
    bin_bits,
    by_slot,
    dealt_texts,
    pack,
    pack_sorted,
    slot_edges,
    summed,
    text_bytes,
    unpack,
    unpack_sorted,
)
from marketgrain.llm.simhash import components

SHINGLE = 5
PERCENT = 80
SHARD_BYTES = 16 << 20
#: Text bytes whose shingles one slot counts; a shingle starts at a word, so there are at most half as many.
SLOT_BYTES = 12 << 20
#: A block holds about so many sets and shared shingles.
BLOCK_SETS, BLOCK_SHINGLES = 512, 4 << 20
#: Index entries listed at once in a tile.
_LISTED = 1 << 21


def missing(n, percent: int = PERCENT):
    """How many of a set's ``n`` shingles a linked set may lack."""
    return n * (100 - percent) // 100


def needed(n_x, n_y, percent: int = PERCENT):
    """The least overlap of two linked sets."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = word_table(texts, fold=True)
    rolled, starts = rolling(words.hashes, size), words.starts.tolist()
    sets = []
    for a, b in zip(starts, starts[1:]):
        if 0 < b - a < size:  # told apart from whole shingles by the length
            sets.append(rolling(words.hashes[a:b], b - a) + np.uint64(b - a))
        else:
            sets.append(np.unique(rolled[a : max(a, b - size + 1)]))
    return sets


def _set_number(shingles: np.ndarray) -> int:
    total = mixed(shingles).sum(dtype=np.uint64)
    return int(mixed(np.array([total ^ np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _member_rows(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            sets = shingle_sets(batch["text"], size)
            columns = [batch["doc_id"], pa.array(map(_set_number, sets), pa.int64()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


# ---- frequencies -------------------------------------------------------------------------------


def _sets_of_shard(texts: pa.Table, size: int) -> Iterator[np.ndarray]:
    """The distinct sets of a shard that are not empty."""
    seen = set()
    for whole in texts.select(["text"]).to_batches():
        for part in by_bytes(whole, "text"):
            for shingles in shingle_sets(part["text"], size):
                if len(shingles) and (number := _set_number(shingles)) not in seen:
                    seen.add(number)
                    yield shingles


def _asked_rows(bits: int, slots: int, size: int):
    schema = pa.schema([("slot", pa.int32()), ("shard", pa.int32()), ("bins", pa.binary()), ("times", pa.binary())])
    shift, edges = np.uint64(64 - bits), slot_edges(bits, slots)

    def run(texts: pa.Table) -> pa.Table:
        sets = list(_sets_of_shard(texts, size))
        if not sets:
            return schema.empty_table()
        bins, times = np.unique(np.concatenate(sets) >> shift, return_counts=True)
        shard = texts["shard"][0].as_py()
        rows = [
            (slot, shard, pack_sorted(bins[a:b]), pack(times[a:b].astype(np.uint64))) for slot, a, b in by_slot(bins, edges)
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _answer_rows(asked: pa.Table) -> pa.Table:
    """For every shard that asked, the bins that occur twice or more and how often."""
    schema = pa.schema([("shard", pa.int32()), ("bins", pa.binary()), ("times", pa.binary())])
    parts = [unpack_sorted(x) for x in asked["bins"].to_pylist()]
    bins, times = summed(np.concatenate(parts), np.concatenate([unpack(x) for x in asked["times"].to_pylist()]), runs=True)
    rows = []
    for shard, part in zip(asked["shard"].to_pylist(), parts):
        total = times[np.searchsorted(bins, part)]
        if (total > 1).any():
            rows.append((shard, pack_sorted(part[total > 1]), pack(total[total > 1])))
    columns = list(zip(*rows)) or [()] * 3
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ordered_rows(bits: int, size: int, percent: int):
    schema = pa.schema(
        [("node", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("n_shared", pa.int64())]
        + [("prefix", pa.list_(pa.int64())), ("shared", pa.binary()), ("ranks", pa.binary())]
    )
    shift = np.uint64(64 - bits)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows and answers.num_rows:
            bins = np.concatenate([unpack_sorted(x) for x in answers["bins"].to_pylist()])
            times = np.concatenate([unpack(x) for x in answers["times"].to_pylist()])
            order = np.argsort(bins)  # slots are disjoint
            bins, times = bins[order], times[order]
            for shingles in _sets_of_shard(texts, size):
                at = np.minimum(np.searchsorted(bins, shingles >> shift), len(bins) - 1)
                shared = bins[at] == shingles >> shift
                n, alone = len(shingles), int(len(shingles) - shared.sum())
                first = missing(n, percent) + 1 - alone
                if first > 0:
                    tokens, often = shingles[shared], times[at[shared]]
                    rare_first = np.lexsort((tokens, often))
                    tokens, often = tokens[rare_first], often[rare_first]
                    prefix = tokens[:first].view(np.int64)
                    rows.append((_set_number(shingles), n, alone, len(tokens), prefix, tokens.tobytes(), often.tobytes()))
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def ordered_sets(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    shard_bytes: int = SHARD_BYTES,
    slot_bytes: int = SLOT_BYTES,
) -> DataFrame:
    """The distinct sets that may link: ``node, n, alone, n_shared, prefix, shared, ranks``.

    ``shared`` holds the hashes of the shingles that are not alone, rare first, ``ranks`` their frequencies.
    """
    texts = docs.select(F.col("text").cast("string")).where("text IS NOT NULL")
    total = text_bytes(texts)
    bits, shards, slots = bin_bits(total), max(1, -(-total // shard_bytes)), max(1, -(-total // slot_bytes))
    dealt = dealt_texts(texts, shards)
    asked = dealt.groupBy("shard").applyInArrow(
        _asked_rows(bits, slots, size), "slot int, shard int, bins binary, times binary"
    )
    answers = asked.groupBy("slot").applyInArrow(_answer_rows, "shard int, bins binary, times binary")
    return (
        dealt.groupBy("shard")
        .cogroup(answers.groupBy("shard"))
        .applyInArrow(
            _ordered_rows(bits, size, percent),
            "node bigint, n bigint, alone bigint, n_shared bigint, prefix array<bigint>, shared binary, ranks binary",
        )
        .dropDuplicates(["node"])  # texts that differ in case or spacing only
    )


# ---- candidates and tiles ----------------------------------------------------------------------


def tiles(sets: DataFrame, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``node, part, root, low, high``: any two sets that share a prefix shingle share exactly one tile."""
    keyed = sets.select("node", F.explode("prefix").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
    several = several.where("centre != last").select("key", "centre")
    met = stored(keyed.join(several, "key"), "jaccard-keys")
    ties = met.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    grouped = stored(components(ties, "jaccard-candidates"), "jaccard-groups")
    placed = sets.select("node", "n_shared").join(grouped, "node")
    weight = F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(block_sets)), F.ceil(F.sum("n_shared") / F.lit(block_shingles))
    )
    sizes = grouped.join(placed.groupBy("root").agg(weight.cast("bigint").alias("parts")), "root")
    whole = sizes.where("parts = 1").select(
        "node", F.lit(0).cast("bigint").alias("part"), "root", *[F.lit(0).cast("bigint").alias(c) for c in ("low", "high")]
    )
    split = sizes.where("parts > 1").select("node", "root", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    held = met.select("node", "key").join(split, "node")
    reached = held.groupBy("key").agg(F.collect_set("part").alias("others"))
    others = F.array_distinct(F.flatten(F.collect_list("others")))
    spread = held.join(reached, "key").groupBy("node", "root", "part").agg(others.alias("others"))
    spread = spread.select("node", "part", "root", F.explode("others").alias("other"))
    return whole.unionByName(
        spread.select("node", "part", "root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    )


class TileSets(NamedTuple):
    """The sets of a tile by size; their shared shingles, as ranks of the rare-first order, one after another."""

    node: np.ndarray
    part: np.ndarray
    n: np.ndarray
    alone: np.ndarray
    copies: np.ndarray
    flat: np.ndarray
    starts: np.ndarray


def _tile_sets(rows: pa.Table) -> TileSets:
    rows = rows.sort_by([("n", "ascending"), ("node", "ascending")])
    node, part, n, alone, copies, sizes = (rows[c].to_numpy() for c in ("node", "part", "n", "alone", "copies", "n_shared"))
    tokens, often = (np.frombuffer(b"".join(rows[c].to_pylist()), "<u8") for c in ("shared", "ranks"))
    distinct, first, place = np.unique(tokens, return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, often[first]))] = np.arange(len(distinct))
    return TileSets(node, part, n, alone, copies, rank[place], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges, one range after another, and the range of each place."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def _chunks(work: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose ``work`` adds up to about ``limit``."""
    ends, at = np.cumsum(work), 0
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def _candidates(s: TileSets, between: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``x, y`` (y the smaller or earlier set), each once, that pass the three filters."""
    m, size = len(s.node), max(1, int(s.flat.max()) + 1) if len(s.flat) else 1
    own = np.repeat(np.arange(m), np.diff(s.starts))
    keyed = own * size + s.flat  # ascending: sets one after another, each rare first
    place = np.arange(len(s.flat)) - s.starts[own]
    at = np.flatnonzero(place < missing(s.n, percent)[own] + 1 - s.alone[own])
    owner, token, place = own[at], s.flat[at], place[at]
    listed = token * m + owner
    order = np.argsort(listed)
    listed, owner_of, place_of = listed[order], owner[order], place[order]
    least = np.searchsorted(s.n, -(-s.n * percent // 100))  # length filter: sizes ascend
    low = np.searchsorted(listed, token * m + least[owner])
    high = np.searchsorted(listed, token * m + owner)
    for a, b in _chunks(high - low, _LISTED):
        entry, probe = _spans(low[a:b], high[a:b])
        probe += a
        x, y, i, j = owner[probe], owner_of[entry], place[probe], place_of[entry]
        if between:
            x, y, i, j = (v[s.part[x] != s.part[y]] for v in (x, y, i, j))
        # a set's entries lie next to each other, rare first: the first of a pair is its first common shingle
        _, first = np.unique(x * m + y, return_index=True)
        x, y, i, j = x[first], y[first], i[first], j[first]
        if a and owner[a - 1] == owner[a]:  # the chunk begins inside a set: pairs met in the chunk before are done
            begun = owner[a]
            before = slice(int(np.searchsorted(owner, begun)), a)
            again = (x == begun) & np.isin(y, owner_of[_spans(low[before], high[before])[0]])
            x, y, i, j = (v[~again] for v in (x, y, i, j))
        need = needed(s.n[x], s.n[y], percent)
        left_x, left_y = s.starts[x + 1] - s.starts[x] - i - 1, s.starts[y + 1] - s.starts[y] - j - 1
        use = 1 + np.minimum(left_x, left_y) >= need  # positional filter
        x, y, i, j, need, left_x, left_y = (v[use] for v in (x, y, i, j, need, left_x, left_y))
        # suffix filter: the middle shingle of y's rest parts both rests; differing sizes of the parts are lost
        middle = left_y // 2
        pivot = s.flat[np.minimum(s.starts[y] + j + 1 + middle, len(s.flat) - 1)]
        cut = np.searchsorted(keyed, x * size + pivot)
        equal = (cut < s.starts[x + 1]) & (s.flat[np.minimum(cut, len(s.flat) - 1)] == pivot)
        before_x = cut - (s.starts[x] + i + 1)
        parted = np.abs(before_x - middle) + np.abs((left_x - before_x - equal) - (left_y - middle - 1)) + ~equal
        lost = np.where(left_y > 0, parted, left_x)
        use = s.alone[x] + i + s.alone[y] + j + lost <= s.n[x] + s.n[y] - 2 * need
        yield x[use], y[use]


def _verified(s: TileSets, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that link, with their overlap; ``x`` ascends."""
    overlap = np.zeros(len(x), np.int64)
    mark = np.zeros(int(s.flat.max()) + 1 if len(s.flat) else 1, bool)
    for probe in np.unique(x).tolist():
        a, b = np.searchsorted(x, [probe, probe + 1])
        own = s.flat[s.starts[probe] : s.starts[probe + 1]]
        mark[own] = True
        for c, d in _chunks(s.starts[y[a:b] + 1] - s.starts[y[a:b]], _LISTED):
            places, which = _spans(s.starts[y[a + c : a + d]], s.starts[y[a + c : a + d] + 1])
            overlap[a + c : a + d] = np.bincount(which[mark[s.flat[places]]], minlength=d - c)
        mark[own] = False
    use = overlap >= needed(s.n[x], s.n[y], percent)
    return x[use], y[use], overlap[use]


def _forest(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """``label`` (the least connected index) after the pairs, and the pairs that connected something."""
    tree, edges = label.tolist(), []

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    apart = label[x] != label[y]
    for i, j in zip(x[apart].tolist(), y[apart].tolist()):
        a, b = root(i), root(j)
        if a != b:
            tree[max(a, b)] = min(a, b)
            edges.append((i, j))
    label = np.array(tree, np.int64)
    while not np.array_equal(label[label], label):
        label = label[label]
    return label, edges


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _tile_rows(percent: int, pairs: bool):
    """Rows ``a, b, n``: all pairs with their overlap, or a forest (n null) and the links of each set (b null)."""

    def run(rows: pa.Table) -> pa.Table:
        between = rows["low"][0].as_py() != rows["high"][0].as_py()
        s = _tile_sets(rows)
        links, label = np.zeros(len(s.node), np.int64), np.arange(len(s.node))
        out: list[pa.Table] = []
        for x, y in _candidates(s, between, percent):
            x, y, overlap = _verified(s, x, y, percent)
            if pairs:
                out.append(pa.table([s.node[x], s.node[y], overlap], schema=_LINKED))
                continue
            np.add.at(links, x, s.copies[y])
            np.add.at(links, y, s.copies[x])
            label, edges = _forest(label, x, y)
            a, b = (s.node[list(c)] for c in zip(*edges)) if edges else ((), ())
            out.append(pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], schema=_LINKED))
        linked = np.flatnonzero(links)
        out.append(pa.table([s.node[linked], pa.nulls(len(linked), pa.int64()), links[linked]], schema=_LINKED))
        return pa.concat_tables(out)

    return run


# ---- results -----------------------------------------------------------------------------------


def members(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, node, n`` of every row: the number of its set, and the set's size."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(_member_rows(size), "doc_id bigint, node bigint, n bigint"), "jaccard-members")


def _linked(docs: DataFrame, held: DataFrame, size: int, percent: int, pairs: bool, options: dict) -> DataFrame:
    blocks = {k: options.pop(k) for k in ("block_sets", "block_shingles") if k in options}
    sets = stored(ordered_sets(docs, size, percent, **options), "jaccard-sets")
    copies = held.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    dealt = tiles(sets, **blocks).join(sets.drop("prefix"), "node").join(copies, "node")
    found = dealt.groupBy("root", "low", "high").applyInArrow(_tile_rows(percent, pairs), "a bigint, b bigint, n bigint")
    return stored(found, "jaccard-links")


def links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, **options: int) -> tuple[DataFrame, DataFrame]:
    """``members`` and every link between different sets: ``a, b`` (set numbers) and the ``overlap``.

    Documents of one set that is not empty link with each other, too.
    """
    held = members(docs, size)
    return held, _linked(docs, held, size, percent, True, options).select("a", "b", F.col("n").alias("overlap"))


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, **options: int) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the least ``doc_id`` reachable by links, ``n_links`` the number of documents linked directly.
    """
    held = members(docs, size)
    found = _linked(docs, held, size, percent, False, options)
    grouped = components(found.where("b IS NOT NULL").select("a", "b"), "jaccard-components")
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    nodes = held.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    placed = (
        nodes.join(grouped, "node", "left")
        .join(counted, "node", "left")
        .select(
            "node",
            "least",
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    placed = stored(placed, "jaccard-nodes")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(named, "root").select("node", "component_id", "n_links")
    some = held.where("n > 0").join(labels, "node").select("doc_id", "n", "component_id", "n_links")
    none = held.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return some.unionByName(none).withColumnRenamed("n", "n_shingles")
